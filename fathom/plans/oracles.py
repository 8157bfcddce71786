"""SQL twins of the plans, for an engine of another make: the same rules, written out by the other dialect."""

from __future__ import annotations

import re
from functools import lru_cache

from fathom.functions.predicates import DuckDialect
from fathom.plans.corpus import corpus_sql
from fathom.plans.twins import file_rules
from fathom.sources.catalog import Rule, load

DUCK = DuckDialect()
#: What the twin engine strips and where it cuts lines; see :mod:`fathom.functions.text`.
TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def files_cte(name: str = "files") -> str:
    return f"{name} AS ({corpus_sql('duck')})"


def lines_cte(files: str = "files") -> str:
    """``lines(path, src, line, text, trimmed)``."""
    return f"""parts AS (SELECT path, src, regexp_split_to_array(src, '\\r?\\n') AS p FROM {files}),
cut AS (SELECT path, src, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM parts),
numbered AS (SELECT path, src, p, unnest(range(1, len(p) + 1)) AS line FROM cut),
lines AS (SELECT path, src, line, p[line] AS text, regexp_replace(p[line], '^\\s+|\\s+$', '', 'g') AS trimmed FROM numbered)"""


def hits_sql(rules: list[Rule], source: str = "lines", line: str = "line") -> str:
    """``(path, line, rule_ord)`` of all rules that hold on rows of a source."""
    cases = ", ".join(f"CASE WHEN {DUCK.render(r.predicate())} THEN {r.ordinal} END" for r in rules)
    return f"SELECT path, {line} AS line, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule_ord FROM {source}"


def catalog_cte(rules: list[Rule] | None = None) -> str:
    quote = lambda v: "NULL" if v is None else DUCK.text(v) if isinstance(v, str) else str(v)
    rows = ", ".join("(" + ", ".join(map(quote, (r.ordinal, r.key, r.rule_id, r.title, r.severity, r.rank, r.category, r.owasp, r.cwe, r.debt))) + ")" for r in (rules or load()))
    return f"catalog(rule_ord, rule_key, rule_id, title, severity, severity_rank, category, owasp, cwe, debt_minutes) AS (VALUES {rows})"


#: Fixed value: the mark that holds issues back.
MARK = r"//\s*NOSONAR\s*(?:([A-Za-z0-9,\s]+?))?(?:\s*[-:]\s*(.+))?$"
#: Patterns with more repetitions than the twin engine compiles.
NOT_COMPILED = ("Complexity:S1111B", "CodeSmell:S1382", "CodeSmell:S1526")


def corpus_cte(table: str = "part", key: str = "p_partkey") -> str:
    return f"files AS ({corpus_sql('duck', table, key)}), {lines_cte()}"


def marks_cte() -> str:
    return f"""marks AS (SELECT path, line, list_filter(regexp_split_to_array(regexp_extract(text, {DUCK.text(MARK)}, 1), '[,\\s]+'), lambda x: x <> '') AS ids,
 nullif(regexp_extract(text, {DUCK.text(MARK)}, 2), '') AS reason FROM lines WHERE regexp_matches(text, {DUCK.text(MARK)}))"""


def issues_cte(on_lines: list[Rule], on_files: list[Rule], table: str, key: str, suppress: bool = True) -> str:
    """``issues`` of predicate rules and of the second pass's rules in SQL, without the suppressed ones."""
    first = "SELECT path, src, '' AS text, '' AS trimmed FROM files"
    hits = f"SELECT path, line, 1 AS col, rule_ord FROM ({hits_sql(on_lines)}" + (f" UNION ALL {hits_sql(on_files, f'({first})', '1')}" if on_files else "") + ")"
    others = [r for r in load() if r.key in sql_rules()]
    hits += "".join(f" UNION ALL SELECT path, line, col, {r.ordinal} FROM ({sql_rules()[r.key]})" for r in others)
    kept = "WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.path = h.path AND m.line = h.line AND (len(m.ids) = 0 OR list_contains(m.ids, c.rule_id)))" if suppress else ""
    return f"""{corpus_cte(table, key)}, {marks_cte()}, hits AS ({hits}), {catalog_cte(on_lines + on_files + others)},
issues AS (SELECT h.path AS file, h.line, h.col AS "column", c.* FROM hits h JOIN catalog c USING (rule_ord) {kept})"""


@lru_cache(maxsize=1)
def sql_rules() -> dict[str, str]:
    """Rules of the second pass in SQL, by key: ``(path, line, col)`` each, written anew from what they are to find."""

    def on_lines(condition: str) -> str:
        return f"SELECT path, line, 1 AS col FROM lines WHERE {condition}"

    def on_files(condition: str) -> str:
        return f"SELECT path, 1 AS line, 1 AS col FROM cut WHERE {condition}"

    def count(text: str, of: str = "text") -> str:
        return f"((length({of}) - length(replace({of}, '{text}', ''))) // {len(text)})"

    def captured(pattern: str, condition: str, column: bool = False) -> str:
        p = DUCK.text(pattern)
        groups = f"SELECT path, line, text, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, 1) AS a, regexp_extract_all(text, {p}, 2) AS b FROM lines WHERE regexp_matches(text, {p})"
        place = "strpos(text, m[1])" if column else "1"
        return f"SELECT path, line, col FROM (SELECT path, line, {place} AS col, unnest(m) AS m, unnest(a) AS a, unnest(b) AS b FROM ({groups})) WHERE {condition}"

    def one_group(pattern: str, condition: str, column: bool = False) -> str:
        p = DUCK.text(pattern)
        at = next(m.start() for m in re.finditer(r"(?<!\\)\(", pattern))
        before, behind = pattern[:at], pattern[at + 1 :]
        # the group's place: behind what comes before it, up to the group's own text
        place = f"length(regexp_extract(text, {DUCK.text('^(.*?' + before + ')(' + behind)}, 1)) + 1" if column else "1"
        return f"SELECT path, line, {place} AS col FROM (SELECT path, line, text, regexp_extract(text, {p}, 1) AS a FROM lines WHERE regexp_matches(text, {p})) WHERE {condition}"

    # Patterns and names, here and in what follows, as the definitions have them.
    pure = "replace|replaceAll|replaceFirst|trim|strip|toUpperCase|toLowerCase|substring|concat|split|format|valueOf|toString|abs|min|max|ceil|floor|round|sqrt|pow|intern"
    var, ret = DUCK.text(r"(\w+)\s+(\w+)\s*=\s*[^;]+;"), DUCK.text(r"return\s+(\w+)\s*;")
    return {
        "Complexity:S1067": on_lines(f"{count('&&')} + {count('||')} > 3"),
        "Security:S6293": on_lines(f"contains(text, 'Pattern.compile') AND {count('+')} + {count('*')} + {count('?')} > 5"),
        "Security:S3649": on_lines(r"""regexp_matches(text, '(executeQuery|executeUpdate|execute|prepareStatement)\s*\([^)]*\+') OR regexp_matches(upper(text), '".*?(SELECT|INSERT|UPDATE|DELETE|WHERE).*?"\s*\+')"""),
        "CodeSmell:S125": on_lines(r"regexp_matches(text, '//\s*(?:if|for|while|return|public|private|protected|class)\s*[\(\{]') OR regexp_matches(text, '//\s*\w+\s*\.\s*\w+\s*\(') OR regexp_matches(text, '//\s*\w+\s*=\s*\w+') OR regexp_matches(text, '/\*\s*(?:if|for|while|return|public|private)')"),
        "Bug:S2201": on_lines(rf"regexp_matches(text, '^\s*\w+\.\s*({pure})\s*\([^)]*\)\s*;')"),
        "CodeSmell:S1451": on_files("len(list_filter(p[1:10], lambda x: contains(x, 'Copyright') OR contains(x, 'copyright'))) = 0"),
        "CodeSmell:S1220": on_files(r"len(list_filter(p, lambda x: regexp_matches(x, '^\s*package '))) = 0"),
        "CodeSmell:S110": on_files(r"len(regexp_extract_all(src, 'class\s+\w+\s+extends\s+\w+')) > 5"),
        "CodeSmell:S1118": on_files(r"contains(src, 'static') AND NOT contains(src, 'new ') AND regexp_matches(src, 'public\s+\w+\s*\(\s*\)')"),
        "CodeSmell:S1210": on_files("(contains(src, 'boolean equals(Object') OR contains(src, 'boolean equals(java.lang.Object')) <> contains(src, 'int hashCode()')"),
        "CodeSmell:S1479": on_files(f"{count('case ', 'src')} > 30"),
        "CodeSmell:S1200": on_files("len(list_filter(p, lambda x: starts_with(x, 'import '))) > 30"),
        "Complexity:S104": on_files("len(p) > 1000"),
        "CodeSmell:S4165": captured(r"(\w+)\s*=\s*(\w+)\s*;", "a = b").replace("unnest(m)", "unnest(m[:1])").replace("unnest(a)", "unnest(a[:1])").replace("unnest(b)", "unnest(b[:1])"),
        "Bug:S1656": captured(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*;", "a = b"),
        "CodeSmell:S3077": one_group(r"volatile\s+(\w+)\s+\w+", "a NOT IN ('int', 'long', 'double', 'float', 'boolean', 'byte', 'short', 'char')"),
        "Bug:S2121": one_group(r"public\s+boolean\s+equals\s*\(\s*(\w+)\s+\w+\s*\)", "a <> 'Object'"),
        "CodeSmell:S112": one_group(r"throw\s+new\s+(Exception|RuntimeException|Throwable|Error)\s*\(", "true", column=True),
        "CodeSmell:S1181": one_group(r"catch\s*\(\s*(Throwable|Error|java\.lang\.Throwable|java\.lang\.Error)\s+", "true", column=True),
        "CodeSmell:S2178": on_lines(r"regexp_matches(text, '\s+([&|])\s+') AND NOT contains(text, '&&') AND NOT contains(text, '||')"),
        "CodeSmell:S1488": f"SELECT path, line, 1 AS col FROM (SELECT *, lead(text) OVER (PARTITION BY path ORDER BY line) AS next FROM lines) WHERE regexp_matches(text, {var}) AND regexp_matches(next, {ret}) AND regexp_extract(text, {var}, 2) = regexp_extract(next, {ret}, 1)",
        "Security:S2089": r"SELECT path, line, 1 AS col FROM (SELECT *, max(contains(text, 'setHttpOnly(true)')::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 5 PRECEDING AND 9 FOLLOWING) AS safe FROM lines) WHERE regexp_matches(text, 'new\s+Cookie\s*\(') AND safe = 0",
        "Security:S2092": r"SELECT path, line, 1 AS col FROM (SELECT *, max(contains(text, 'setSecure(true)')::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 5 PRECEDING AND 9 FOLLOWING) AS safe FROM lines) WHERE regexp_matches(text, 'new\s+Cookie\s*\(') AND safe = 0",
        "CodeSmell:S1192": """SELECT path, min(line) AS line, 1 AS col FROM (SELECT path, line, unnest(regexp_extract_all(text, '"([^"]{4,})"', 1)) AS t FROM lines) GROUP BY path, t HAVING count(*) >= 3""",
        "CodeSmell:S3959": r"SELECT path, line, 1 AS col FROM (SELECT path, line, row_number() OVER (PARTITION BY path, v ORDER BY line, k) AS n FROM (SELECT path, line, unnest(regexp_extract_all(text, '(\w+)\.stream\(\)', 1)) AS v, generate_subscripts(regexp_extract_all(text, '(\w+)\.stream\(\)', 1), 1) AS k FROM lines)) WHERE n > 1",
        "Complexity:S1820": r"SELECT path, greatest(1, len(regexp_split_to_array(regexp_extract(src, '(?s)^(.*?)class\s+\w+', 1), '\n')) + CASE WHEN regexp_matches(src, '(?s)^class') OR regexp_matches(regexp_extract(src, '(?s)^(.*?)class\s+\w+', 1), '\n$') THEN 0 ELSE 1 END) AS line, 1 AS col FROM cut WHERE regexp_matches(src, 'class\s+\w+') AND len(regexp_extract_all(src, '(?:private|protected|public)\s+(?:static\s+)?(?:final\s+)?(?:\w+)\s+\w+\s*[=;]')) > 20",
    } | file_rules()
