"""Aggregates over issues: counts, debt, hotspots, compliance, gates, exit status."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.naming import format_debt
from fathom.sources.catalog import SEVERITIES

# Hotspot categories by rule, names of weakness classes and of the ten risk categories.
HOTSPOT_CATEGORIES = {
    "Authentication": ["S2068", "S1421", "S2078"],
    "Cryptography": ["S4790", "S2277", "S5547"],
    "Injection": ["S3649", "S2076", "S2631"],
    "Cross-Site Scripting": ["S5131", "S5247"],
    "Insecure Configuration": ["S4507", "S5693"],
    "Sensitive Data": ["S2162B", "S1350"],
}
CWE_NAMES = {22: "Path Traversal", 78: "OS Command Injection", 79: "Cross-site Scripting (XSS)", 89: "SQL Injection", 90: "LDAP Injection", 117: "Log Injection", 200: "Information Exposure", 295: "Improper Certificate Validation", 311: "Missing Encryption", 319: "Cleartext Transmission", 326: "Inadequate Encryption Strength", 327: "Use of Broken Crypto Algorithm", 330: "Use of Insufficient Random Values", 352: "Cross-Site Request Forgery (CSRF)", 377: "Insecure Temporary File", 384: "Session Fixation", 434: "Unrestricted Upload", 470: "Unsafe Reflection", 502: "Deserialization of Untrusted Data", 521: "Weak Password Requirements", 601: "Open Redirect", 611: "XML External Entity (XXE)", 614: "Sensitive Cookie Without Secure Flag", 639: "Authorization Bypass Through User-Controlled Key", 798: "Hardcoded Credentials", 862: "Missing Authorization", 916: "Weak Password Hash", 918: "Server-Side Request Forgery (SSRF)", 1333: "Inefficient Regular Expression (ReDoS)"}
OWASP_NAMES = {"A01": "Broken Access Control", "A02": "Cryptographic Failures", "A03": "Injection", "A04": "Insecure Design", "A05": "Security Misconfiguration", "A06": "Vulnerable and Outdated Components", "A07": "Identification and Authentication Failures", "A08": "Software and Data Integrity Failures", "A09": "Security Logging and Monitoring Failures", "A10": "Server-Side Request Forgery"}
#: Minutes up to which a rating holds.
RATINGS = (("A", 30), ("B", 120), ("C", 480), ("D", 1440))
ROOT = "(root)"


def lookup(key: Column, table: dict, otherwise: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(otherwise))


def grouped(issues: DataFrame, by: str) -> DataFrame:
    """``(by, n)``; issues of no module are those of the root."""
    key = F.coalesce(F.col(by), F.lit(ROOT)) if by == "module" else F.col(by)
    return issues.groupBy(key.alias(by)).agg(F.count("*").alias("n"))


def debt_summary(issues: DataFrame) -> DataFrame:
    """``(dimension, name, minutes, n)``: the total and the sums by severity, category, file, rule and module, in one pass."""
    keys = ["severity", "category", "file", "rule_id", "module"]
    sets = issues.select(*keys[:-1], F.coalesce("module", F.lit(ROOT)).alias("module"), "debt_minutes")
    out = sets.groupingSets([[F.col(k)] for k in keys] + [[]], *map(F.col, keys)).agg(F.sum("debt_minutes").alias("minutes"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
    # a key's bit is 0 in its own set; all bits are 1 in the total
    full = 2 ** len(keys) - 1
    dimension, name = F.lit("total"), F.lit("total")
    for n, k in enumerate(keys):
        here = F.col("gid") == full - 2 ** (len(keys) - 1 - n)
        dimension, name = F.when(here, F.lit(k)).otherwise(dimension), F.when(here, F.col(k)).otherwise(name)
    return out.select(dimension.alias("dimension"), name.alias("name"), F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"), "n")


def debt_top(issues: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """The keys with the most debt; of equal ones the first by name."""
    sums = issues.groupBy(F.col(by).alias("name")).agg(F.sum("debt_minutes").cast("long").alias("minutes"), F.count("*").alias("n"))
    return sums.orderBy(F.desc("minutes"), "name").limit(limit)


def debt_breakdown(issues: DataFrame, by: str = "category") -> DataFrame:
    """``(name, minutes, percentage)`` with shares of the whole, 0 if that is 0.

    The whole is one row that is broadcast; both sides read the same sums.
    """
    sums = issues.groupBy(F.col(by).alias("name")).agg(F.sum("debt_minutes").cast("long").alias("minutes")).withColumn("one", F.lit(1))
    whole = F.broadcast(sums.groupBy("one").agg(F.sum("minutes").alias("whole")))
    share = F.when(F.col("whole") > 0, F.col("minutes") * 100.0 / F.col("whole")).otherwise(0.0)
    return sums.join(whole, "one").select("name", "minutes", share.alias("percentage"))


def rating(minutes: Column) -> Column:
    return F.coalesce(*[F.when(minutes <= most, F.lit(name)) for name, most in RATINGS], F.lit("E"))


def debt_rating(issues: DataFrame, most: int | None = None) -> DataFrame:
    """One row: total, rating, text, and whether the total is at most ``most``."""
    total = issues.agg(F.coalesce(F.sum("debt_minutes"), F.lit(0)).cast("long").alias("minutes"))
    return total.select("minutes", rating(F.col("minutes")).alias("rating"), format_debt(F.col("minutes")).alias("text"), (F.lit(True) if most is None else F.col("minutes") <= most).alias("acceptable"))


def hotspots(issues: DataFrame) -> DataFrame:
    """Issues to be looked at for security, with probability, impact, priority, category and status."""
    known = {r: c for c, rules in HOTSPOT_CATEGORIES.items() for r in rules}
    picked = issues.where((F.col("category") == "Security") | F.col("rule_id").isin(*known))
    likely = F.when(F.col("severity").isin("blocker", "critical"), "high").when(F.col("severity") == "major", "medium").otherwise("low")
    return picked.select("file", "line", "rule_id", "rule_key", "severity", likely.alias("probability"), F.lit("medium").alias("impact"), priority(likely, F.lit("medium")).alias("priority"), lookup(F.col("rule_id"), known, "Other").alias("hotspot_category"), F.lit("to_review").alias("status"), F.lit(None).cast("string").alias("review_comment"))


def priority(probability: Column, impact: Column) -> Column:
    """By the sum of two grades of low, medium and high."""
    grade = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    both = grade(probability) + grade(impact)
    return F.when(both >= 3, "High").when(both == 2, "Medium").otherwise("Low")


def reviewed(spots: DataFrame, decisions: DataFrame) -> DataFrame:
    """Hotspots with the status and comment of ``decisions(file, line, rule_id, status, review_comment)`` where there is one."""
    d = decisions.select("file", "line", "rule_id", F.col("status").alias("new_status"), F.col("review_comment").alias("new_comment"))
    joined = spots.join(d, ["file", "line", "rule_id"], "left")
    return joined.withColumns({"status": F.coalesce("new_status", "status"), "review_comment": F.coalesce("new_comment", "review_comment")}).drop("new_status", "new_comment")


def hotspot_summary(spots: DataFrame) -> DataFrame:
    """Counts by priority, by category and by status, in one pass."""
    keys = {"priority": "priority", "category": "hotspot_category", "status": "status"}
    out = spots.groupingSets([[F.col(c)] for c in keys.values()], *map(F.col, keys.values())).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    # of the three bits that of a set's own key is 0
    sets = {7 - 4: "priority", 7 - 2: "category", 7 - 1: "status"}
    dimension, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for gid, key in sets.items():
        dimension, name = F.when(F.col("gid") == gid, F.lit(key)).otherwise(dimension), F.when(F.col("gid") == gid, F.col(keys[key])).otherwise(name)
    return out.select(dimension.alias("dimension"), name.alias("name"), "n")


#: Shares into which a key's issues are divided before the first of each are picked.
SHARES = 256


def _first_issues(issues: DataFrame, key: str, shown: int) -> DataFrame:
    """``(key, n, examples)``: the number of issues of each key and the first of them in order.

    A key's issues are first divided by file, each share tells its number and its first ones, and only these meet; so a
    frequent key is no single task's, and the issues are read once.
    """
    order = ["file", "rule_ord", "line", "column"]
    share = issues.where(F.col(key).isNotNull()).select(key, *order, "rule_id", F.pmod(F.xxhash64("file"), F.lit(SHARES)).alias("share"))
    within = Window.partitionBy(key, "share")
    first = share.withColumns({"at": F.row_number().over(within.orderBy(*order)), "held": F.count("*").over(within)}).where(F.col("at") <= shown)
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    text = F.concat("rule_id", F.lit(" "), "file", F.lit(":"), F.col("line").cast("string"))
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", text.alias("text")))))
    return ranked.groupBy(key).agg(F.sum(F.when(F.col("at") == 1, F.col("held"))).cast("long").alias("n"), F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("examples"))


def owasp_report(issues: DataFrame, shown: int = 5) -> DataFrame:
    """All ten categories with counts, and the first issues of each."""
    codes = F.broadcast(issues.sparkSession.createDataFrame(list(OWASP_NAMES.items()), "owasp string, name string"))  # ten rows
    counts = _first_issues(issues, "owasp", shown)
    return codes.join(counts, "owasp", "left").select("owasp", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def cwe_report(issues: DataFrame, shown: int = 3) -> DataFrame:
    """Weakness numbers with names and counts, the most frequent first, and the first issues of each."""
    counts = _first_issues(issues, "cwe", shown)
    return counts.select("cwe", lookup(F.col("cwe"), CWE_NAMES, "Unknown").alias("name"), "n", "examples").orderBy(F.desc("n"), "cwe")


#: Built-in gates: conditions (type, severity, threshold).
GATES = {
    "strict": [("no_issues_above", "critical", None), ("max_issues", "major", 10), ("max_debt_minutes", None, 60)],
    "standard": [("no_issues_above", "blocker", None), ("max_issues", "critical", 5), ("max_debt_minutes", None, 120)],
    "lenient": [("no_issues_above", "blocker", None)],
}


def gate_conditions(issues: DataFrame, conditions: Iterable[tuple]) -> DataFrame:
    """``(position, type, severity, threshold, actual, passed)`` of each condition, from one pass over the issues.

    New issues are all issues, as there is no baseline here, and a least share of resolved ones always passes.
    """
    rows = [(n, *c) for n, c in enumerate(conditions)]
    measures = [F.count("*").alias("total"), F.coalesce(F.sum("debt_minutes"), F.lit(0)).cast("long").alias("debt")]
    measures += [F.count_if(F.col("severity") == s).alias(f"is_{s}") for s in SEVERITIES] + [F.count_if(F.col("severity_rank") >= k).alias(f"from_{s}") for k, s in enumerate(SEVERITIES)]

    def measure(kind, severity):
        return {"max_issues": f"is_{severity}", "no_issues_above": f"from_{severity}", "max_debt_minutes": "debt"}.get(kind, "total")

    results = [F.struct(F.lit(n).alias("position"), F.lit(k).alias("type"), F.lit(s).alias("severity"), F.lit(t).cast("long").alias("threshold"), F.col(measure(k, s)).cast("long").alias("actual"), (F.lit(True) if k == "min_issues_resolved_percent" else F.col(measure(k, s)) <= (t or 0)).alias("passed")) for n, k, s, t in rows]
    return issues.agg(*measures).select(F.explode(F.array(*results)).alias("c")).select("c.*")


def gate_passed(issues: DataFrame, conditions: Iterable[tuple]) -> DataFrame:
    """One row: whether every condition holds; a gate without conditions passes."""
    conditions = list(conditions)
    if not conditions:
        return issues.limit(0).agg(F.lit(True).alias("passed"))
    return gate_conditions(issues, conditions).agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def exit_status(issues: DataFrame, gate: Iterable[tuple] = (), fail_on_issues: bool = False, fail_on_severity: str | None = None) -> DataFrame:
    """One row: whether a run is a success."""
    conditions = list(gate)
    conditions += [("max_total_issues", None, 0)] * fail_on_issues
    conditions += [("no_issues_above", fail_on_severity, None)] if fail_on_severity else []
    return gate_passed(issues, conditions)
