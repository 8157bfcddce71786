"""Queries of the analysis over a generated corpus, each with its twin in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import baseline, coverage, declarations, duplication, metrics, modules, reviews
from fathom.operators.file_pass import custom_hits, source_hits
from fathom.operators.counted_rules import KEYS
from fathom.operators.line_engine import all_hits, file_hits, file_lines, file_predicates, line_hits, line_rules
from fathom.operators.suppression import suppressions, unsuppressed
from fathom.plans import oracles
from fathom.plans.analysis import Config, active_rules, all_issues, described, issues_of_rules
from fathom.plans.corpus import corpus
from fathom.plans.oracles import DUCK
from fathom.sinks import reports
from fathom.sources.catalog import CATEGORIES, SEVERITIES, Rule, catalog, load
from fathom.streaming.watch import debounced_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The table that the corpus of sources is made from, and its key.
PART = ("part", "p_partkey")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def compiled_rules(rules: list[Rule]) -> list[Rule]:
    """Rules that both engines have patterns for."""
    return [r for r in rules if r.key not in oracles.NOT_COMPILED]


def all_line_rules() -> list[Rule]:
    return compiled_rules(line_rules())


#: Rules that both engines know: predicates, and those of the second pass that are written out in SQL.
_SQL_RULES = oracles.sql_rules()


def shared_rules() -> list[Rule]:
    return compiled_rules([r for r in active_rules() if r.key in _SQL_RULES or r.predicate() is not None])


def issues(spark: SparkSession, sf_dir: str, modules: DataFrame | None = None, context: bool = False) -> DataFrame:
    """Issues of those rules over the corpus, without the suppressed ones; every message is the rule's title, as in SQL."""
    found = issues_of_rules(corpus(spark, sf_dir, *PART), shared_rules(), modules=modules, context=context)
    return found.withColumn("message", F.col("title"))


def over_issues(select: str, with_: str = "") -> str:
    return f"WITH {oracles.issues_cte(all_line_rules(), file_predicates(), *PART)}{', ' + with_ if with_ else ''} {select}"


# Rules


def _category_query(label: str, category: str) -> None:
    rules = [r for r in all_line_rules() if r.category == category]

    def run(spark, sf_dir):
        found = described(line_hits(corpus(spark, sf_dir, *PART), rules))
        return found.select("file", "line", "column", "rule_key", "severity", "severity_rank", "debt_minutes", "owasp", "cwe", "message", "code_snippet")

    sql = f"WITH {oracles.corpus_cte(*PART)}, hits AS ({oracles.hits_sql(rules)}), {oracles.catalog_cte(rules)} SELECT h.path AS file, h.line::INT AS line, 1 AS \"column\", rule_key, severity, severity_rank, debt_minutes, owasp, cwe, title AS message, trimmed AS code_snippet FROM hits h JOIN catalog USING (rule_ord) JOIN lines l ON l.path = h.path AND l.line = h.line"
    query(f"rules_{label.lower().replace(' ', '_')}", sql)(run)


for _label, _category in CATEGORIES.items():
    _category_query(_label, _category)


@query("rules_on_files", f"WITH {oracles.corpus_cte(*PART)} {oracles.hits_sql(file_predicates(), "(SELECT path, src, '' AS text, '' AS trimmed FROM files)", '1')}")
def rules_on_files(spark, sf_dir):
    return file_hits(corpus(spark, sf_dir, *PART), file_predicates()).select("path", "line", "rule_ord")


@query("rules_on_sources")
def rules_on_sources(spark, sf_dir):
    """All rules of the second pass."""
    found = source_hits(corpus(spark, sf_dir, *PART), active_rules())
    return found.select("path", "line", "column", "message", F.col("trimmed").alias("code_snippet"), "severity", "rule_ord")


@query("rules_on_sources_in_sql", f"WITH {oracles.corpus_cte(*PART)} " + " UNION ALL ".join(f"SELECT path, line::INT AS line, col::INT AS \"column\", '{k}' AS rule_key FROM ({sql})" for k, sql in _SQL_RULES.items()))
def rules_on_sources_in_sql(spark, sf_dir):
    """Those of the second pass that have been written out in SQL."""
    rules = [r for r in load() if r.key in _SQL_RULES]
    found = source_hits(corpus(spark, sf_dir, *PART), rules)
    return found.join(F.broadcast(catalog(spark).select("rule_ord", "rule_key")), "rule_ord").select("path", "line", "column", "rule_key")


_COUNTED = {k: sql for k, sql in _SQL_RULES.items() if k in KEYS}


@query("counted_rules", f"WITH {oracles.corpus_cte(*PART)} " + " UNION ALL ".join(f"SELECT path, line::INT AS line, '{k}' AS rule_key FROM ({sql})" for k, sql in _COUNTED.items()))
def counted_rules(spark, sf_dir):
    """Rules by captures and counts, as the pass in the JVM finds them."""
    found = all_hits(corpus(spark, sf_dir, *PART), [], counted=[r for r in load() if r.key in _COUNTED])
    return found.join(F.broadcast(catalog(spark).select("rule_ord", "rule_key")), "rule_ord").select("path", "line", "rule_key")


@query("long_repetition_rules")
def long_repetition_rules(spark, sf_dir):
    return line_hits(corpus(spark, sf_dir, *PART), [r for r in line_rules() if r.key in oracles.NOT_COMPILED]).select("path", "line", "rule_ord")


@query("analyse")
def analyse(spark, sf_dir):
    """All rules over the corpus, without suppressed issues: the main query."""
    return all_issues(corpus(spark, sf_dir, *PART)).select("file", "line", "column", "rule_key", "severity", "message", "debt_minutes")


_CUSTOM = [(0, r"\w+\(\)", "a call without arguments", r"^\s*//"), (1, r"[0-9]{2,}", "a number", None)]


@query("custom_rules", f"""WITH {oracles.corpus_cte(*PART)}, found AS (
SELECT path, line, unnest(regexp_extract_all(text, '\\w+\\(\\)')) AS m, 0 AS rule_ord FROM lines WHERE NOT regexp_matches(text, '^\\s*//')
UNION ALL SELECT path, line, unnest(regexp_extract_all(text, '[0-9]{{2,}}')), 1 FROM lines)
SELECT path, line::INT AS line, rule_ord, count(*) AS n, sum(length(m))::BIGINT AS width FROM found GROUP BY ALL""")
def custom_rules(spark, sf_dir):
    found = custom_hits(corpus(spark, sf_dir, *PART), _CUSTOM)
    return found.groupBy("path", "line", "rule_ord").agg(F.count("*").alias("n"), F.sum(F.col("end_column") - F.col("column")).alias("width"))


# The catalogue, with what the corpus has of each rule

_EVERY = oracles.catalog_cte().replace("catalog(", "every(", 1) + ", hit AS (SELECT rule_ord, count(*) AS n_issues FROM issues GROUP BY rule_ord), told AS (SELECT every.*, coalesce(n_issues, 0) AS n_issues FROM every LEFT JOIN hit USING (rule_ord))"
_ACTIVE = Config(min_severity="critical", disabled_rules=("S2068", "S5542"))


def _told(spark: SparkSession, sf_dir: str, rules: DataFrame) -> DataFrame:
    """Rules with the number of their issues in the corpus."""
    hit = issues(spark, sf_dir).groupBy("rule_ord").agg(F.count("*").alias("n_issues"))
    return rules.join(hit, "rule_ord", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))


@query("catalog", over_issues("SELECT category, severity, count(*) AS n, count(DISTINCT rule_id) AS ids, sum(debt_minutes)::BIGINT AS minutes, sum(n_issues)::BIGINT AS n_issues, count(*) FILTER (n_issues > 0) AS broken FROM told GROUP BY ALL", _EVERY))
def catalog_counts(spark, sf_dir):
    rules = _told(spark, sf_dir, catalog(spark))
    return rules.groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("ids"), F.sum("debt_minutes").alias("minutes"), F.sum("n_issues").alias("n_issues"), F.count_if(F.col("n_issues") > 0).alias("broken"))


@query("catalog_by_category", over_issues("SELECT rule_key, rule_id, title, severity, n_issues FROM told WHERE contains(lower(category), 'secur')", _EVERY))
def catalog_by_category(spark, sf_dir):
    return _told(spark, sf_dir, catalog(spark, "secur")).select("rule_key", "rule_id", "title", "severity", "n_issues")


@query("rule_selection", over_issues("SELECT rule_key, n_issues FROM told WHERE severity_rank >= 3 AND rule_id NOT IN ('S2068', 'S5542')", _EVERY))
def rule_selection(spark, sf_dir):
    chosen = spark.createDataFrame([(r.ordinal, r.key) for r in active_rules(_ACTIVE)], "rule_ord int, rule_key string")
    return _told(spark, sf_dir, chosen).select("rule_key", "n_issues")


# Declarations

# Imports and string literals, as the definition has them
_IMPORT, _STRING = r"import\s+([\w.]+(?:\.\*)?)\s*;", r'"([^"\\]|\\.)*"'


@query("imports", f"WITH {oracles.corpus_cte(*PART)}, found AS (SELECT path, unnest(regexp_extract_all(src, {DUCK.text(_IMPORT)}, 1)) AS name FROM files) SELECT name, count(*) AS n, count(DISTINCT path) AS files FROM found GROUP BY ALL")
def import_counts(spark, sf_dir):
    return declarations.imports(corpus(spark, sf_dir, *PART)).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query("uses_import", f"WITH {oracles.corpus_cte(*PART)} SELECT path, len(list_filter(regexp_extract_all(src, {DUCK.text(_IMPORT)}, 1), lambda x: contains(x, 'util'))) > 0 AS uses FROM files")
def uses_import(spark, sf_dir):
    files = corpus(spark, sf_dir, *PART)
    return files.select("path", declarations.uses_import(files.src, "util").alias("uses"))


@query("string_literals", f"WITH {oracles.corpus_cte(*PART)} SELECT path, line::INT AS line, unnest(regexp_extract_all(text, {DUCK.text(_STRING)})) AS literal FROM lines")
def string_literals(spark, sf_dir):
    return declarations.string_literals(corpus(spark, sf_dir, *PART))


@query("declarations")
def declared(spark, sf_dir):
    return declarations.declarations(corpus(spark, sf_dir, *PART))


# Lines, suppression


@query("lines", f"WITH {oracles.corpus_cte(*PART)} SELECT path, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(length(trimmed))::BIGINT AS trimmed_chars FROM lines GROUP BY path")
def lines(spark, sf_dir):
    return file_lines(corpus(spark, sf_dir, *PART)).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.length("trimmed")).alias("trimmed_chars"))


@query("suppressions", f"WITH {oracles.corpus_cte(*PART)}, {oracles.marks_cte()} SELECT path AS file, line::INT AS line, array_to_string(ids, ' ') AS ids, reason FROM marks")
def suppression_marks(spark, sf_dir):
    return suppressions(corpus(spark, sf_dir, *PART)).select("file", "line", F.array_join("rule_ids", " ").alias("ids"), "reason")


@query("issues", over_issues("SELECT file, line::INT AS line, \"column\"::INT AS \"column\", rule_key, severity FROM issues"))
def issue_rows(spark, sf_dir):
    return issues(spark, sf_dir).select("file", "line", "column", "rule_key", "severity")


@query("unsuppressed", f"WITH {oracles.issues_cte(all_line_rules(), file_predicates(), *PART)} SELECT file, line::INT AS line, rule_key FROM issues")
def unsuppressed_by_join(spark, sf_dir):
    """The join that takes marks out of issues from elsewhere."""
    files = corpus(spark, sf_dir, *PART)
    return unsuppressed(issues_of_rules(files, shared_rules(), suppress=False), files).select("file", "line", "rule_key")


# Aggregates

for _by in ("file", "rule_id", "severity", "category"):
    query(f"issues_by_{_by}", over_issues(f"SELECT {_by}, count(*) AS n FROM issues GROUP BY ALL"))(lambda spark, sf_dir, by=_by: reviews.grouped(issues(spark, sf_dir), by))



@query("debt_summary", over_issues(" UNION ALL ".join([f"SELECT '{k}' AS dimension, {k} AS name, sum(debt_minutes)::BIGINT AS minutes, count(*) AS n FROM issues GROUP BY {k}" for k in ("severity", "category", "file", "rule_id")] + ["SELECT 'module', '(root)', sum(debt_minutes)::BIGINT, count(*) FROM issues", "SELECT 'total', 'total', sum(debt_minutes)::BIGINT, count(*) FROM issues"])))
def debt_summary(spark, sf_dir):
    return reviews.debt_summary(issues(spark, sf_dir))


for _by in ("file", "rule_id"):
    query(f"debt_top_{_by}", over_issues(f"SELECT {_by} AS name, sum(debt_minutes)::BIGINT AS minutes, count(*) AS n FROM issues GROUP BY {_by} ORDER BY minutes DESC, name LIMIT 10"))(lambda spark, sf_dir, by=_by: reviews.debt_top(issues(spark, sf_dir), by))


@query("debt_breakdown", over_issues("SELECT category AS name, sum(debt_minutes)::BIGINT AS minutes, sum(debt_minutes)::BIGINT * 100.0::DOUBLE / sum(sum(debt_minutes)::BIGINT) OVER ()::DOUBLE AS percentage FROM issues GROUP BY category"))
def debt_breakdown(spark, sf_dir):
    return reviews.debt_breakdown(issues(spark, sf_dir))


@query("debt_rating", over_issues("SELECT m AS minutes, CASE WHEN m <= 30 THEN 'A' WHEN m <= 120 THEN 'B' WHEN m <= 480 THEN 'C' WHEN m <= 1440 THEN 'D' ELSE 'E' END AS rating, array_to_string(list_filter([CASE WHEN m // 480 > 0 THEN (m // 480) || 'd' END, CASE WHEN m % 480 // 60 > 0 THEN (m % 480 // 60) || 'h' END, CASE WHEN m % 60 > 0 OR m = 0 THEN (m % 60) || 'min' END], lambda x: x IS NOT NULL), ' ') AS text, m <= 5000 AS acceptable FROM (SELECT coalesce(sum(debt_minutes), 0)::BIGINT AS m FROM issues)"))
def debt_rating(spark, sf_dir):
    return reviews.debt_rating(issues(spark, sf_dir), 5000)


_KNOWN = [(r, c) for c, rules in reviews.HOTSPOT_CATEGORIES.items() for r in rules]
_SPOTS = f"known(rule_id, hotspot_category) AS (VALUES {', '.join(f"('{r}', '{c}')" for r, c in _KNOWN)}), spots AS (SELECT i.*, coalesce(k.hotspot_category, 'Other') AS hotspot_category, CASE WHEN severity IN ('blocker', 'critical') THEN 'high' WHEN severity = 'major' THEN 'medium' ELSE 'low' END AS probability, CASE WHEN severity IN ('blocker', 'critical') THEN 'High' WHEN severity = 'major' THEN 'Medium' ELSE 'Low' END AS priority FROM issues i LEFT JOIN known k USING (rule_id) WHERE category = 'Security' OR k.rule_id IS NOT NULL)"


@query("hotspots", over_issues("SELECT file, line::INT AS line, rule_key, probability, 'medium' AS impact, priority, hotspot_category, 'to_review' AS status FROM spots", _SPOTS))
def hotspot_rows(spark, sf_dir):
    return reviews.hotspots(issues(spark, sf_dir)).select("file", "line", "rule_key", "probability", "impact", "priority", "hotspot_category", "status")


@query("hotspot_summary", over_issues("SELECT 'priority' AS dimension, priority AS name, count(*) AS n FROM spots GROUP BY ALL UNION ALL SELECT 'category', hotspot_category, count(*) FROM spots GROUP BY ALL UNION ALL SELECT 'status', 'to_review', count(*) FROM spots GROUP BY ALL", _SPOTS))
def hotspot_summary(spark, sf_dir):
    return reviews.hotspot_summary(reviews.hotspots(issues(spark, sf_dir)))


def _first(key: str, shown: int) -> str:
    return f"ranked AS (SELECT {key}, file, line, rule_id, row_number() OVER (PARTITION BY {key} ORDER BY file, rule_ord, line) AS pos FROM issues WHERE {key} IS NOT NULL), counts AS (SELECT {key}, count(*) AS n, string_agg(CASE WHEN pos <= {shown} THEN rule_id || ' ' || file || ':' || line END, ', ' ORDER BY pos) AS examples FROM ranked GROUP BY {key})"


@query("owasp_report", over_issues("SELECT owasp, name, coalesce(n, 0) AS n, coalesce(examples, '') AS examples FROM codes LEFT JOIN counts USING (owasp)", f"codes(owasp, name) AS (VALUES {', '.join(f"({DUCK.text(k)}, {DUCK.text(v)})" for k, v in reviews.OWASP_NAMES.items())}), {_first('owasp', 5)}"))
def owasp_report(spark, sf_dir):
    return reviews.owasp_report(issues(spark, sf_dir))


@query("cwe_report", over_issues("SELECT cwe, coalesce(name, 'Unknown') AS name, n, examples FROM counts LEFT JOIN codes USING (cwe)", f"codes(cwe, name) AS (VALUES {', '.join(f'({k}, {DUCK.text(v)})' for k, v in reviews.CWE_NAMES.items())}), {_first('cwe', 3)}"))
def cwe_report(spark, sf_dir):
    return reviews.cwe_report(issues(spark, sf_dir))


def _condition_sql(n: int, kind: str, severity: str | None, threshold: int | None) -> str:
    rank = SEVERITIES.index(severity) if severity else 0
    actual = {"max_issues": f"count(*) FILTER (severity_rank = {rank})", "no_issues_above": f"count(*) FILTER (severity_rank >= {rank})", "max_debt_minutes": "coalesce(sum(debt_minutes), 0)::BIGINT"}.get(kind, "count(*)")
    passed = "true" if kind == "min_issues_resolved_percent" else f"{actual} <= {threshold or 0}"
    return f"SELECT {n} AS position, '{kind}' AS type, {'NULL' if severity is None else DUCK.text(severity)} AS severity, {'NULL' if threshold is None else threshold}::BIGINT AS threshold, {actual} AS actual, {passed} AS passed FROM issues"


_GATE = [*reviews.GATES["strict"], *reviews.GATES["standard"], ("max_total_issues", None, 100_000), ("max_new_issues", None, 5), ("min_issues_resolved_percent", None, 50)]


@query("gate_conditions", over_issues(" UNION ALL ".join(_condition_sql(n, *c) for n, c in enumerate(_GATE))))
def gate_conditions(spark, sf_dir):
    return reviews.gate_conditions(issues(spark, sf_dir), _GATE)


@query("gate_presets", over_issues(" UNION ALL ".join(f"SELECT '{name}' AS gate, bool_and(passed) AS passed FROM ({' UNION ALL '.join(_condition_sql(n, *c) for n, c in enumerate(conditions))})" for name, conditions in reviews.GATES.items())))
def gate_presets(spark, sf_dir):
    found = issues(spark, sf_dir)
    conditions = [(name, c) for name, cs in reviews.GATES.items() for c in cs]
    names = F.element_at(F.array(*[F.lit(name) for name, _ in conditions]), F.col("position") + 1)
    return reviews.gate_conditions(found, [c for _, c in conditions]).groupBy(names.alias("gate")).agg(F.bool_and("passed").alias("passed"))


@query("exit_status", over_issues("SELECT count(*) FILTER (severity_rank >= 4) = 0 AND count(*) FILTER (severity_rank >= 3) <= 0 AS passed FROM issues"))
def exit_status(spark, sf_dir):
    return reviews.exit_status(issues(spark, sf_dir), reviews.GATES["lenient"], fail_on_severity="critical")


# Baselines: the earlier run lacks some lines and has others; some issues of both have no hash, and some of the earlier run
# have another one

_HASHED = """around AS (SELECT path, line, ('0x' || md5(concat_ws(chr(10), lag(trimmed) OVER w, trimmed, lead(trimmed) OVER w))[:16])::UBIGINT AS h FROM lines WINDOW w AS (PARTITION BY path ORDER BY line)),
now AS (SELECT rule_id, file, i.line, CASE WHEN i.line % 7 <> 0 THEN h END AS context_hash FROM issues i LEFT JOIN around a ON a.path = i.file AND a.line = i.line),
baseline AS (SELECT rule_id, file, line, CASE WHEN line % 4 = 0 THEN NULL WHEN line % 11 = 0 THEN 1 ELSE context_hash END AS context_hash FROM now WHERE line % 3 <> 0 UNION ALL SELECT rule_id, file, line + 1000, context_hash FROM now WHERE line % 5 = 0)"""
_SAME = " AND ".join(f"b.{k} IS NOT DISTINCT FROM i.{k}" for k in baseline.KEY)
_BASE = {kind: f"SELECT {{}} FROM {a} WHERE {'' if kind == 'unchanged' else 'NOT '}EXISTS (SELECT 1 FROM {b} WHERE {_SAME})" for kind, a, b in (("new", "now i", "baseline b"), ("unchanged", "now i", "baseline b"), ("fixed", "baseline b", "now i"))}


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both runs' fingerprints from one pass over the sources: each issue gives its rows of either."""
    found = issues(spark, sf_dir, context=True)
    line = F.col("line")
    own = F.when(line % 7 != 0, F.col("context_hash"))
    row = lambda when, at, hash_, now: F.when(when, F.struct(at.alias("line"), hash_.cast(baseline.HASH).alias("context_hash"), F.lit(now).alias("now"), F.lit(1 - now).alias("then")))
    earlier = F.when(line % 4 == 0, None).when(line % 11 == 0, F.lit(1).cast(baseline.HASH)).otherwise(own)
    rows = F.array_compact(F.array(row(F.lit(True), line, own, 1), row(line % 3 != 0, line, earlier, 0), row(line % 5 == 0, line + 1000, own, 0)))
    return baseline.tally(found.select("rule_id", "file", F.explode(rows).alias("r")).select("rule_id", "file", "r.*"))


for _kind, _sql in _BASE.items():
    query(f"baseline_{_kind}", over_issues(_sql.format(f"rule_id, file, line::INT AS line, {'b' if _kind == 'fixed' else 'i'}.context_hash::DECIMAL(20, 0) AS context_hash"), _HASHED))(lambda spark, sf_dir, kind=_kind: baseline.told(_tally(spark, sf_dir), kind))


@query("baseline_comparison", over_issues(f"SELECT n AS \"new\", f AS fixed, u AS unchanged, n - f AS net_change FROM (SELECT {', '.join(f"({sql.format('count(*)')}) AS {kind[0]}" for kind, sql in _BASE.items())})", _HASHED))
def baseline_comparison(spark, sf_dir):
    return baseline.counted(_tally(spark, sf_dir))


# Modules

_MODULES = [("work", "/work"), ("one", "/work/src/m1"), ("two", "/work/src/m2/"), ("src", "/work/src"), ("m", "/work/src/m")]
_MODULES_SQL = f"modules(name, path) AS (VALUES {', '.join(f"('{n}', '{p.rstrip('/')}')" for n, p in _MODULES)}), placed AS (SELECT i.file, i.line, i.rule_key, (SELECT max_by(m.name, length(m.path)) FROM modules m WHERE starts_with(i.file, m.path || '/')) AS module FROM issues i)"


def _modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MODULES, "name string, path string")


@query("module_of_issue", over_issues("SELECT DISTINCT file, module FROM placed", _MODULES_SQL))
def module_of_issue(spark, sf_dir):
    return issues(spark, sf_dir, _modules(spark)).select("file", "module").distinct()


@query("module_counts", over_issues("SELECT m.name, (CASE WHEN m.name = 'two' THEN m.path || '/' ELSE m.path END) AS path, count(p.file) AS n FROM modules m LEFT JOIN placed p ON p.module = m.name GROUP BY ALL", _MODULES_SQL))
def module_counts(spark, sf_dir):
    return modules.counts(issues(spark, sf_dir, _modules(spark)), _modules(spark))


@query("module_filter", over_issues("SELECT module, count(*) AS n FROM placed WHERE module IN ('one', 'src') AND module <> 'src' GROUP BY ALL", _MODULES_SQL))
def module_filter(spark, sf_dir):
    placed = issues(spark, sf_dir, _modules(spark))
    return modules.only(placed, include=["one", "src"], exclude=["src"]).groupBy("module").agg(F.count("*").alias("n"))


# Copies

_RUNS = r"""normal AS (SELECT path, list_transform(p, lambda x: trim(split_part(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g'), '//', 1))) AS p FROM cut),
runs AS (SELECT path AS file, s AS start_line, array_to_string(p[s:s + 5], chr(10)) AS t FROM (SELECT path, p, unnest(range(1, len(p) - 4)) AS s FROM normal)),
kept AS (SELECT file, start_line, md5(t) AS hash FROM runs WHERE length(replace(t, chr(10), '')) > 0), again AS (SELECT hash, count(*) AS n FROM kept GROUP BY hash HAVING count(*) > 1)"""


@query("duplicate_places", f"WITH {oracles.corpus_cte(*PART)}, {_RUNS} SELECT hash, file, start_line::INT AS start_line, (start_line + 5)::INT AS end_line FROM kept WHERE hash IN (SELECT hash FROM again)")
def duplicate_places(spark, sf_dir):
    return duplication.duplicate_places(corpus(spark, sf_dir, *PART)).select("hash", "file", "start_line", "end_line")


@query("duplication_summary", f"WITH {oracles.corpus_cte(*PART)}, {_RUNS}, hit AS (SELECT DISTINCT file, unnest(range(start_line, start_line + 6)) AS line FROM kept WHERE hash IN (SELECT hash FROM again)) SELECT b AS blocks, d AS duplicated_lines, t AS total_lines, d * 100.0::DOUBLE / t::DOUBLE AS percentage FROM (SELECT (SELECT count(*) FROM again) AS b, (SELECT count(*) FROM hit) AS d, (SELECT count(*) FROM lines) AS t)")
def duplication_summary(spark, sf_dir):
    return duplication.duplication_summary(corpus(spark, sf_dir, *PART))


# Coverage: a trace made from line items, a record each; some have no lines, and some lines no count

_TRACE_LINE = """SELECT 'trace' AS source, (l_orderkey * 10 + l_linenumber) * 1000 + k AS {at}, CASE WHEN k = 0 THEN concat('SF:src/', CASE WHEN l_linenumber = 7 THEN 'empty' ELSE 'o' END, l_orderkey % 400, '.java')
WHEN k = 900 THEN 'end_of_record' WHEN k % 7 = 6 OR l_linenumber = 7 THEN concat('BRDA:', k, ',0,0,1') ELSE concat('DA:', l_linenumber * 10 + k, ',', CASE WHEN l_suppkey % 11 = 0 THEN -1 ELSE l_suppkey % 3 END) END AS value"""
_TRACE = _TRACE_LINE + """
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, {each} AS k FROM {table})"""


def _trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the trace; the operator leaves out copies of items, which are alike in their keys, where it has few lines left."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("trace_items")
    items = "l_orderkey, l_linenumber, l_suppkey"
    text = spark.sql(f"{_TRACE_LINE.format(at='at')}, {items} FROM (SELECT {items}, explode(array(0, 1, 2, 3, 6, 8, 900)) AS k FROM trace_items)")
    return coverage.lcov_lines(text, coverage.BLOCK_LINES * 1000 // 7, repeated=True)  # 7 lines in 1,000 numbers


_COVERED = f"""trace AS ({_TRACE.format(at='"at"', each='unnest([0, 1, 2, 3, 6, 8, 900])', table='lineitem')}),
owned AS (SELECT *, t."at" // 1000 AS record FROM trace t), heads AS (SELECT record, substr(value, 4) AS file FROM owned WHERE starts_with(value, 'SF:')), latest AS (SELECT file, max(record) AS record FROM heads GROUP BY file),
counted AS (SELECT record, split_part(substr(value, 4), ',', 1)::BIGINT AS line, split_part(value, ',', 2)::BIGINT AS hits FROM owned WHERE starts_with(value, 'DA:')),
covered AS (SELECT file, line, hits FROM latest LEFT JOIN (SELECT * FROM counted WHERE hits >= 0) USING (record)),
by_file AS (SELECT file, count(*) FILTER (hits > 0) AS covered, count(*) FILTER (hits = 0) AS uncovered FROM covered GROUP BY file),
shares AS (SELECT *, CASE WHEN covered + uncovered > 0 THEN covered * 100.0::DOUBLE / (covered + uncovered)::DOUBLE ELSE 0::DOUBLE END AS percentage FROM by_file)"""


@query("coverage_files", f"WITH {_COVERED} SELECT * FROM shares")
def coverage_files(spark, sf_dir):
    return coverage.file_coverage(_trace_lines(spark, sf_dir))


@query("coverage_total", f"WITH {_COVERED} SELECT c AS covered, u AS uncovered, c * 100.0::DOUBLE / (c + u)::DOUBLE AS percentage, c * 100.0::DOUBLE / (c + u)::DOUBLE >= 60 AS passed FROM (SELECT sum(covered)::BIGINT AS c, sum(uncovered)::BIGINT AS u FROM shares)")
def coverage_total(spark, sf_dir):
    return coverage.total_coverage(_trace_lines(spark, sf_dir), 60)


@query("coverage_gaps", f"WITH {_COVERED} SELECT file, line FROM covered WHERE hits = 0 AND file IN (SELECT file FROM shares WHERE percentage < 50)")
def coverage_gaps(spark, sf_dir):
    return coverage.uncovered_below(_trace_lines(spark, sf_dir), 50)


@query("coverage_below", f"WITH {_COVERED} SELECT file, percentage FROM shares WHERE percentage < 50")
def coverage_below(spark, sf_dir):
    return coverage.below(_trace_lines(spark, sf_dir), 50).select("file", "percentage")


_XML = """SELECT 'report' AS source, (l_orderkey * 10 + l_linenumber) * 1000 + k AS {at}, CASE WHEN k = 0 THEN concat('<sourcefile name="F', l_orderkey % 300, '.java">') WHEN k = 900 THEN '</sourcefile>'
ELSE concat('  <line nr="', (l_linenumber - 1) * k, '" mi="1" ci="', l_suppkey % 3, '" mb="0" cb="0"/>') END AS value
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, {each} AS k FROM {table})"""


@query("coverage_xml", f"""WITH report AS ({_XML.format(at='"at"', each='unnest([0, 1, 2, 5, 900])', table='lineitem')}),
owned AS (SELECT *, t."at" // 1000 AS record, regexp_extract(value, '"([^"]*)"', 1) AS first FROM report t),
latest AS (SELECT first AS file, max(record) AS record FROM owned WHERE contains(value, 'name=') GROUP BY ALL),
covered AS (SELECT file, (regexp_extract(value, 'ci="([0-9]+)"', 1)::BIGINT) AS hits FROM latest JOIN owned USING (record) WHERE contains(value, '<line') AND first::BIGINT > 0)
SELECT file, count(hits) FILTER (hits > 0) AS covered, count(hits) FILTER (hits = 0) AS uncovered, CASE WHEN count(hits) > 0 THEN count(hits) FILTER (hits > 0) * 100.0::DOUBLE / count(hits)::DOUBLE ELSE 0::DOUBLE END AS percentage FROM (SELECT file, NULL AS hits FROM latest UNION ALL SELECT * FROM covered) GROUP BY file""")
def coverage_xml(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("trace_items")
    return coverage.file_coverage(coverage.jacoco_lines(spark.sql(_XML.format(at="at", each="explode(array(0, 1, 2, 5, 900))", table="trace_items"))))


# Metrics, cache, changes


# What counts as a class and as a method, as the definition has it
_CLASS = r"\bclass\s+\w+"
_METHOD = r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+)\s+\w+\s*\([^)]*\)\s*\{"


@query("source_metrics", f"WITH {oracles.corpus_cte(*PART)}, n AS (SELECT path, count(*) AS total_lines, count(*) FILTER (regexp_matches(trimmed, '^(//|/[*]|[*])')) AS comment_lines, count(*) FILTER (trimmed = '') AS blank_lines FROM lines GROUP BY path) SELECT path, coalesce(total_lines, 0) AS total_lines, coalesce(total_lines - comment_lines - blank_lines, 0) AS code_lines, coalesce(comment_lines, 0) AS comment_lines, coalesce(blank_lines, 0) AS blank_lines, len(regexp_extract_all(src, {DUCK.text(_CLASS)})) AS classes, len(regexp_extract_all(src, {DUCK.text(_METHOD)})) AS methods FROM files LEFT JOIN n USING (path)")
def source_metrics(spark, sf_dir):
    return metrics.source_metrics(corpus(spark, sf_dir, *PART))


def _listing(spark: SparkSession, sf_dir: str, shifted: int) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.where(f"p_partkey % 7 <> {shifted}").selectExpr("concat('f', cast(p_partkey as string)) as path", f"cast(p_partkey % 11 + if(p_partkey % 5 = {shifted}, 1, 0) as bigint) as modified", "cast(p_size as bigint) as size")


_CACHE = "now AS (SELECT 'f' || p_partkey AS path, p_partkey % 11 + CASE WHEN p_partkey % 5 = 1 THEN 1 ELSE 0 END AS modified, p_size::BIGINT AS size FROM part WHERE p_partkey % 7 <> 1), old AS (SELECT 'f' || p_partkey AS path, p_partkey % 11 + CASE WHEN p_partkey % 5 = 2 THEN 1 ELSE 0 END AS modified, p_size::BIGINT AS size FROM part WHERE p_partkey % 7 <> 2), split AS (SELECT now.*, coalesce(now.modified = old.modified AND now.size = old.size, false) AS hit FROM now LEFT JOIN old USING (path))"


@query("cache_split", f"WITH {_CACHE} SELECT path, modified, size, hit FROM split")
def cache_split(spark, sf_dir):
    return metrics.cache_split(_listing(spark, sf_dir, 1), _listing(spark, sf_dir, 2))


@query("cache_stats", f"WITH {_CACHE} SELECT h AS hits, m AS misses, h * 100.0::DOUBLE / (h + m)::DOUBLE AS hit_rate FROM (SELECT count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS m FROM split)")
def cache_stats(spark, sf_dir):
    return metrics.cache_stats(cache_split(spark, sf_dir))


@query("cache_pruned", f"WITH {_CACHE} SELECT path, modified, size FROM old SEMI JOIN now USING (path)")
def cache_pruned(spark, sf_dir):
    return metrics.pruned(_listing(spark, sf_dir, 2), _listing(spark, sf_dir, 1))


@query("watch_bursts", "WITH e AS (SELECT 'u' || user_id || '.java' AS path, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), b AS (SELECT path, ts, sum(CASE WHEN epoch_us(ts) - epoch_us(before) >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e) SELECT path, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM b GROUP BY path, burst")
def watch_bursts(spark, sf_dir):
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".java")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    bursts = debounced_batch(changes, 3600)
    return bursts.select("path", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


# Reports


@query("report_csv", over_issues("SELECT '\"' || file || '\",' || line || ',' || \"column\" || ',' || severity || ',' || rule_id || ',\"' || replace(title, '\"', '\"\"') || '\",\"' || replace(title, '\"', '\"\"') || '\"' AS value FROM issues"))
def report_csv(spark, sf_dir):
    return reports.csv_lines(issues(spark, sf_dir))


@query("report_sarif", over_issues("SELECT rule_id, CASE WHEN severity_rank >= 3 THEN 'error' WHEN severity_rank = 2 THEN 'warning' ELSE 'note' END AS level, title AS text, file AS uri, line::INT AS line FROM issues"))
def report_sarif(spark, sf_dir):
    rows = reports.sarif_results(issues(spark, sf_dir))
    row = F.from_json("value", "ruleId string, level string, message struct<text: string>, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>")
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select(row.alias("r")).select(F.col("r.ruleId").alias("rule_id"), "r.level", "r.message.text", at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"))


@query("report_gitlab", over_issues("SELECT rule_id AS check_name, rule_id || ': ' || title AS description, severity, substr(md5(rule_id || chr(1) || file || chr(1) || line || chr(1) || title), 1, 16) AS fingerprint, CASE WHEN starts_with(file, '/') AND contains(substr(file, 2), '/src/') THEN substr(substr(file, 2), instr(substr(file, 2), '/src/') + 1) ELSE file END AS path, line::INT AS line FROM issues"))
def report_gitlab(spark, sf_dir):
    rows = reports.gitlab_rows(issues(spark, sf_dir))
    row = F.from_json("value", "check_name string, description string, severity string, fingerprint string, location struct<path: string, lines: struct<begin: int>>")
    return rows.select(row.alias("r")).select("r.check_name", "r.description", "r.severity", "r.fingerprint", "r.location.path", F.col("r.location.lines.begin").alias("line"))


@query("report_json", over_issues("SELECT rule_id, file, line::INT AS line, severity, category, debt_minutes, owasp, cwe FROM issues"))
def report_json(spark, sf_dir):
    rows = reports.json_rows(issues(spark, sf_dir))
    return rows.select(F.from_json("value", "rule_id string, file string, line int, severity string, category string, debt_minutes int, owasp string, cwe int").alias("r")).select("r.*")
