"""SQL twins of the operators that SQL can express, for an engine of another make."""

from __future__ import annotations

from fathom.llm.line_rules import BOILERPLATE, BOILERPLATE_WORDS, LONG_LINE, MAX_ODD_WORDS, MAX_REPEAT_PERCENT, MIN_KEPT, MIN_WORDS, WINDOW
from fathom.llm.vectors import COSINE

_END = r"""[.!?…:;,。！？]["'”’)\]]*"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FURNITURE = " OR ".join(f"contains(lower(line), {_sql(p)})" for p in BOILERPLATE)
LINE_RULES = rf"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
positions AS (SELECT k, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM worded WHERE len(words) >= {WINDOW}),
windows AS (SELECT k, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM positions),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS j FROM again) GROUP BY k),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM texts),
judged AS (SELECT k, line, regexp_extract_all(line, '\S+') AS words, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled, regexp_matches(line, {_sql(_END)}) AS ended FROM lines),
passing AS (SELECT k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, filled AND NOT (
  len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]{{2,}}|[!?]{{2,}}|^[|<>»›·•/\\-]+$'))) > {MAX_ODD_WORDS} * len(words) AND len(words) > 0
  OR len(regexp_extract_all(line, '\s[|»›·•]\s')) >= 3 AND NOT ended
  OR len(words) <= {BOILERPLATE_WORDS} AND ({_FURNITURE})
  OR len(words) >= {LONG_LINE} AND NOT ended) AS ok FROM judged),
good AS (SELECT k, sum(CASE WHEN ok THEN n ELSE 0 END) AS n FROM passing GROUP BY k),
repeats AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM judged WHERE filled GROUP BY k),
counted AS (SELECT w.k, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(r.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_good
  FROM worded w LEFT JOIN covered c USING (k) LEFT JOIN repeats r USING (k) LEFT JOIN good g USING (k)),
failing AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_good >= {MIN_KEPT} * n_words AS kept FROM failing
"""

VECTORS = f"""
WITH RECURSIVE sound AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""

ORACLE_SQL: dict[str, str] = {"op6_line_rules": LINE_RULES, "op8_vectors": VECTORS}
