"""From files to issues: the rules' hits, joined to the catalogue, without those that are suppressed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.counted_rules import KEYS
from fathom.operators.file_pass import findings, with_fix
from fathom.operators.line_engine import all_hits, file_predicates, line_rules
from fathom.operators.modules import with_module
from fathom.operators.source_rules import Limits
from fathom.operators.suppression import held
from fathom.sources.catalog import SEVERITIES, Rule, catalog, load
from fathom.sources.custom_rules import CustomRule, custom_catalog

#: Columns of an issue, in order.
ISSUE = ("rule_key", "rule_id", "title", "severity", "severity_rank", "category", "file", "line", "column", "end_line", "end_column", "message", "code_snippet", "owasp", "cwe", "debt_minutes", "module", "fix", "rule_ord")
FIX = "struct<message: string, edits: array<struct<start_line: int, start_column: int, end_line: int, end_column: int, replacement: string>>>"


@dataclass(frozen=True)
class Config:
    """What is analysed, and with which limits."""

    min_severity: str = "info"
    enabled_rules: tuple[str, ...] | None = None
    disabled_rules: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ("target/", "build/", "node_modules/", ".git/")
    max_complexity: int = 15
    max_params: int = 7
    max_nesting: int = 4
    fail_on_severity: str | None = None
    output_format: str | None = None
    custom_rules_file: str | None = None
    custom_rules: tuple[CustomRule, ...] = ()


def active_rules(config: Config = Config(), rules: tuple[Rule, ...] | None = None) -> list[Rule]:
    """Rules that a plan is made for: by the rule's own severity and by id, both registrations of an id alike."""
    least = SEVERITIES.index(config.min_severity)
    wanted = None if config.enabled_rules is None else set(config.enabled_rules)
    return [r for r in (load() if rules is None else rules) if r.rank >= least and r.rule_id not in config.disabled_rules and (wanted is None or r.rule_id in wanted)]


def described(hits: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Hits ``(path, line, trimmed, rule_ord)`` as issues; further columns of an issue in the hits are kept."""
    rules = F.broadcast((catalog(hits.sparkSession) if rules is None else rules).drop("kind"))  # one row a rule
    own = "severity" in hits.columns
    hits = hits.withColumnRenamed("severity", "own_severity") if own else hits
    joined = hits.join(rules, "rule_ord").withColumnsRenamed({"path": "file", "trimmed": "code_snippet"})
    if own:
        rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("own_severity")) - 1
        joined = joined.withColumns({"severity": F.coalesce("own_severity", "severity"), "severity_rank": F.when(F.col("own_severity").isNull(), F.col("severity_rank")).otherwise(rank).cast("int")})
    found = set(joined.columns)
    # a finding's own message, else the rule's, else its title
    said = F.coalesce(*[F.col(c) for c in ("message", "rule_message", "title") if c in found])
    joined = joined.withColumn("message", said)
    defaults = {"column": F.lit(1), "end_line": F.lit(None).cast("int"), "end_column": F.lit(None).cast("int"), "module": F.lit(None).cast("string"), "fix": F.lit(None).cast(FIX)}
    return joined.withColumns({k: v for k, v in defaults.items() if k not in found}).select(*ISSUE, *[c for c in ("context_hash",) if c in found])


def issues_of_rules(files: DataFrame, rules: list[Rule], limits: Limits = Limits(), custom: tuple[CustomRule, ...] = (), suppress: bool = True, modules: DataFrame | None = None, context: bool = False) -> DataFrame:
    """Issues of these rules in ``files(path, src)``, without the suppressed ones.

    The rules that keep a state, and custom ones, find their places as a column of the file; the predicates and the rules that
    compare captures or count judge each different line once, and the files' lines are looked up.  A mark stands on the issue's
    own line, so it is read with the line.  Given ``modules(name, path)``, each issue has the module of its file.  With ``context``, a further column
    ``context_hash`` is of the lines around an issue.  The different lines are found when this is called and written once.  The
    custom rules' places in the catalogue come after those of the built-in ones.
    """
    first, spark = len(load()), files.sparkSession
    own = [(first + n, c.rule_id, c.pattern, c.message, c.negative_pattern) for n, c in enumerate(custom)]
    known = catalog(spark)
    known = known.unionByName(custom_catalog(spark, custom, first), allowMissingColumns=True) if custom else known
    files, placed = (files, None) if modules is None else with_module(files, modules)
    counted, rest = [r for r in rules if r.key in KEYS], [r for r in rules if r.key not in KEYS]
    hits = all_hits(files, line_rules(rules), file_predicates(rules), findings(rest, limits, suppress, own, context), suppress, ["module"] if modules is not None and placed is None else [], context, counted)
    if suppress:
        names = F.broadcast(known.select("rule_ord", "rule_id"))  # one row a rule
        hits = hits.join(names, "rule_ord").where(~held(F.col("ids"), F.col("rule_id"))).drop("rule_id")
    if placed is not None:
        hits = hits.join(placed, "path", "left")
    return described(with_fix(hits.drop("ids", *["context_hash"] * (not context))), known)


def all_issues(files: DataFrame, config: Config = Config(), modules: DataFrame | None = None) -> DataFrame:
    """Issues of all active rules, with the configuration's limits and custom rules, and each file's module if given."""
    limits = Limits(config.max_complexity, config.max_params, config.max_nesting)
    return issues_of_rules(files, active_rules(config), limits, config.custom_rules, modules=modules)
