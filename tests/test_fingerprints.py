"""Baselines with and without hashes of the lines around, one pass over the sources, and modules that come with the file."""

import hashlib
from decimal import Decimal

import pytest

from fathom.operators import baseline, modules
from fathom.operators.file_pass import context_hash
from fathom.plans import queries
from fathom.plans.analysis import Config, active_rules, all_issues, issues_of_rules

KEYS = "rule_id string, file string, line int, context_hash decimal(20,0)"
LARGE = Decimal(2**64 - 1)


def rows(spark, *keys):
    return spark.createDataFrame(keys, KEYS)


def keys(df):
    return sorted(((r.rule_id, r.file, r.line, r.context_hash) for r in df.collect()), key=str)


NOW = [("S1", "a", 1, None), ("S1", "a", 1, Decimal(5)), ("S1", "a", 2, LARGE), ("S1", "a", 2, LARGE), ("S2", "b", 1, Decimal(7)), ("S3", "c", 1, None)]
THEN = [("S1", "a", 1, Decimal(5)), ("S1", "a", 2, LARGE), ("S2", "b", 1, None), ("S2", "b", 1, None), ("S3", "c", 1, None)]


def test_hashes_are_part_of_the_key(spark):
    now, then = rows(spark, *NOW), rows(spark, *THEN)
    want = {"new": [NOW[0], NOW[4]], "unchanged": [NOW[1], NOW[2], NOW[3], NOW[5]], "fixed": [THEN[2], THEN[3]]}
    tally = baseline.tally(baseline.both(now, then))
    for kind, expected in want.items():
        assert keys(baseline.told(tally, kind)) == sorted(expected, key=str)
        assert keys(getattr(baseline, kind)(now, then)) == sorted(expected, key=str)
    assert tuple(baseline.comparison(now, then).first()) == (2, 2, 4, 0)
    assert tuple(baseline.comparison(now, rows(spark)).first()) == (6, 0, 0, 6)


def test_issues_without_hashes(spark):
    plain = rows(spark, *NOW).drop("context_hash")
    assert baseline.new(plain, rows(spark, *THEN)).columns == ["rule_id", "file", "line"]
    assert {(r.rule_id, r.line) for r in baseline.new(plain, rows(spark, *THEN)).collect()} == {("S1", 1), ("S1", 2)}
    assert {(r.rule_id, r.line) for r in baseline.unchanged(plain, rows(spark, *THEN)).collect()} == {("S2", 1), ("S3", 1)}


@pytest.mark.parametrize("form", ["lines", "document"])
def test_saved_and_read(spark, tmp_path, form):
    path = str(tmp_path / "b")
    if form == "lines":
        baseline.save(rows(spark, *NOW), path)
    else:
        (tmp_path / "b").write_text("".join(baseline.document(rows(spark, *NOW))))
    then = baseline.load(spark, path)
    assert keys(then) == sorted(NOW, key=str)
    assert baseline.new(rows(spark, *NOW), then).count() == 0


SOURCE = "class A {\n  // TODO: one\n    int x;\n\n  // TODO: two\n}\n"


def test_hash_of_the_lines_around(spark):
    texts = {"A": SOURCE, "B": "\n\n" + SOURCE, "C": SOURCE.replace("int x;", "int y;"), "D": "   " + SOURCE.replace("\n", "  \r\n"), "E": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, src string")
    found = issues_of_rules(files, active_rules(), context=True)
    by = {(r.file, r.rule_id, r.line): r.context_hash for r in found.collect()}
    around = lambda *t: Decimal(int(hashlib.md5("\n".join(t).encode()).hexdigest()[:16], 16))
    one = around("class A {", "// TODO: one", "int x;")
    assert by["A", "S1135", 2] == by["B", "S1135", 4] == by["D", "S1135", 2] == one
    assert by["C", "S1135", 2] == around("class A {", "// TODO: one", "int y;") and by["A", "S1135", 5] == by["C", "S1135", 5] == around("", "// TODO: two", "}")
    lines = {k: [line.rstrip("\r") for line in t.split("\n")[:-1]] for k, t in texts.items()}
    assert len(by) > 10 and all(h == context_hash(lines[f], n) for (f, _, n), h in by.items())
    assert context_hash(["a"], 2) is None and "context_hash" not in issues_of_rules(files, active_rules()).columns


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan"), plan.count("ArrowEvalPython") + plan.count("MapInArrow")


@pytest.fixture
def tables(spark, tmp_path):
    for name in ("part", "supplier"):
        spark.range(40).selectExpr("id as p_partkey", "id as s_suppkey").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["analyse", "issues", "debt_summary", "baseline_new", "baseline_fixed", "baseline_comparison"])
def test_one_scan(spark, tables, name):
    assert scans(queries.QUERIES[name](spark, tables)) == (1, 1)


@pytest.mark.parametrize("name", ["module_of_issue", "module_filter"])
def test_modules_come_with_the_file(spark, tables, name):
    # the second function in Python is the look-up, in the same scan
    assert scans(queries.QUERIES[name](spark, tables)) in ((1, 1), (1, 2))


def test_many_modules(spark, monkeypatch):
    table = spark.createDataFrame([(f"m{n}", f"/w/g{n % 100}/m{n}{'/' * (n % 3)}") for n in range(10_000)] + [("w", "/w"), ("", "/none")], "name string, path string")
    paths = [f"/w/g{n % 100}/m{n}/src/A.java" for n in range(0, 10_000, 501)] + ["/w/g1/m10/A.java", "/w/B.java", "/v/C.java", "D.java"]
    files = spark.createDataFrame([(p, "// TODO: x\n") for p in paths], "path string, src string")
    want = {p: f"m{n}" for p, n in zip(paths, range(0, 10_000, 501))} | {"/w/g1/m10/A.java": "w", "/w/B.java": "w", "/v/C.java": None, "D.java": None}
    config = Config(enabled_rules=("S1135",))
    found = all_issues(files, config, table)
    assert {r.file: r.module for r in found.collect()} == want
    monkeypatch.setattr(modules, "SENT_MODULES", 100)
    joined = all_issues(files, config, table)
    assert {r.file: r.module for r in joined.collect()} == want and joined.columns == found.columns
    assert {r.file: r.module for r in modules.assign(joined.drop("module").selectExpr("*", "string(null) as module"), table).collect()} == want
