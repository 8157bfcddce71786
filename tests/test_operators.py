import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathom.operators import autofix, baseline, coverage, duplication, metrics, modules, reviews
from fathom.plans.analysis import Config, all_issues
from fathom.sinks import reports
from fathom.sources import builds, files, settings
from fathom.streaming import watch

JAVA = 'package a;\npublic class bad {\n    private static final int maxSize = 1;\n    void f() { System.out.println("x"); } // TODO\n    String password = "hunter22";\n}\n'


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, body in {"src/A.java": JAVA, "src/deep/B.java": JAVA.replace("bad", "Good"), "target/C.java": JAVA, "src/notes.txt": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    (root / "src/Broken.java").write_bytes(b"class \xff\xfe {")
    return root


@pytest.fixture(scope="module")
def issues(spark, project):
    return all_issues(files.scan(spark, str(project))).cache()


def test_scan(spark, project):
    rows = {r.path: r.src for r in files.scan(spark, str(project)).collect()}
    assert {p.removeprefix(str(project)) for p in rows} == {"/src/A.java", "/src/deep/B.java", "/src/Broken.java"}
    assert rows[f"{project}/src/Broken.java"] is None and rows[f"{project}/src/A.java"] == JAVA
    assert files.scan_all(spark, str(project)).count() == 4 and files.files_analysed(files.scan(spark, str(project))) == 3
    assert files.scan_one(spark, f"{project}/src/notes.txt").first().src == "x"
    listed = files.listing(spark, str(project))
    assert listed.count() == 4 and {r.size for r in listed.collect()} >= {len(JAVA)}


def test_analysis_of_a_folder(issues):
    found = {(r.file.rpartition("/")[2], r.rule_key, r.line) for r in issues.collect()}
    assert {("A.java", "Naming:S101", 2), ("A.java", "Naming:S115", 3), ("A.java", "CodeSmell:S106", 4), ("A.java", "CodeSmell:S1135", 4), ("A.java", "Security:S2068", 5)} <= found
    assert ("B.java", "Naming:S101", 2) not in found


def test_fixes(spark, project, issues):
    fixed = {r.path.rpartition("/")[2]: r.src for r in autofix.fixed_files(files.scan(spark, str(project)), issues).collect()}
    assert "public class Bad {" in fixed["A.java"] and "int MAX_SIZE = 1" in fixed["A.java"] and not fixed["A.java"].endswith("\n")
    edit = lambda line, a, b, text: {"start_line": line, "start_column": a, "end_line": line, "end_column": b, "replacement": text}
    assert autofix.apply_edits("é b c\nd", [edit(1, 4, 5, "X"), edit(1, 6, 7, "YY")]) == "é X YY\nd"


def test_debt(spark):
    rows = spark.createDataFrame([("a", "S1", "minor", "Bug", 5, None), ("a", "S2", "major", "Bug", 30, "m"), ("b", "S1", "minor", "Naming", 500, "m")], "file string, rule_id string, severity string, category string, debt_minutes int, module string")
    got = {(r.dimension, r.name): (r.minutes, r.n) for r in reviews.debt_summary(rows).collect()}
    assert got[("total", "total")] == (535, 3) and got[("file", "a")] == (35, 2) and got[("module", "(root)")] == (5, 1) and got[("rule_id", "S1")] == (505, 2) and got[("category", "Naming")] == (500, 1)
    row = reviews.debt_rating(rows, 500).first()
    assert (row.minutes, row.rating, row.text, row.acceptable) == (535, "D", "1d 55min", False)
    empty = reviews.debt_rating(rows.limit(0)).first()
    assert (empty.rating, empty.text) == ("A", "0min")
    assert {r.name: round(r.percentage, 2) for r in reviews.debt_breakdown(rows, "file").collect()} == {"a": 6.54, "b": 93.46}
    assert [r.name for r in reviews.debt_top(rows, "rule_id", 1).collect()] == ["S1"]


@pytest.mark.parametrize(("probability", "impact", "want"), [("high", "medium", "High"), ("medium", "high", "High"), ("medium", "medium", "Medium"), ("high", "low", "Medium"), ("low", "medium", "Low"), ("low", "low", "Low")])
def test_priorities(spark, probability, impact, want):
    assert spark.range(1).select(reviews.priority(F.lit(probability), F.lit(impact)).alias("p")).first().p == want


def test_reviews(spark, issues):
    spots = reviews.hotspots(issues)
    one = spots.where("rule_id = 'S2068'").first()
    assert (one.priority, one.hotspot_category, one.status) == ("High", "Authentication", "to_review")
    decisions = spark.createDataFrame([(one.file, one.line, one.rule_id, "safe", "test data")], "file string, line int, rule_id string, status string, review_comment string")
    assert reviews.reviewed(spots, decisions).where("status = 'safe'").count() == 1


def test_gates(spark, issues):
    assert reviews.gate_passed(issues, [("no_issues_above", "blocker", None)]).first().passed is False
    assert reviews.gate_passed(issues.where("severity = 'minor'"), reviews.GATES["lenient"]).first().passed
    assert reviews.gate_passed(issues, []).first().passed and reviews.gate_passed(issues.limit(0), reviews.GATES["strict"]).first().passed
    assert reviews.exit_status(issues).first().passed and not reviews.exit_status(issues, fail_on_issues=True).first().passed
    text = json.dumps({"name": "g", "conditions": [{"type": "max_total_issues", "threshold": 1}, {"type": "max_issues", "severity": "major", "threshold": 0}]})
    assert settings.gate(text) == [("max_total_issues", None, 1), ("max_issues", "major", 0)]
    with pytest.raises(ValueError):
        settings.gate('{"conditions": [{"type": "max_issues", "severity": "Major"}]}')
    assert settings.gate_or_pass("/nowhere") == []


def test_baseline(spark, tmp_path, issues):
    baseline.save(issues, str(tmp_path / "b"))
    then = baseline.load(spark, str(tmp_path / "b"))
    assert baseline.new(issues, then).count() == 0 and baseline.fixed(issues, then).count() == 0
    fewer = then.where("rule_id <> 'S106'")
    assert {r.rule_id for r in baseline.new(issues, fewer).collect()} == {"S106"}
    row = baseline.comparison(issues, fewer.unionByName(spark.createDataFrame([("S0", "x", 1), ("S0", "x", 1)], "rule_id string, file string, line int"))).first()
    assert row.fixed == 2 and row.new == baseline.new(issues, fewer).count() and row.net_change == row.new - 2
    (tmp_path / "one.json").write_text(json.dumps({"version": "1.0", "fingerprints": [{"rule_id": "S1", "file": "a", "line": 3}]}, indent=1))
    assert baseline.load(spark, str(tmp_path / "one.json")).first().line == 3


def test_duplication(spark):
    block = "".join(f"call{n}();\n" for n in range(8))
    df = spark.createDataFrame([("a", block), ("b", "x();\n" + block.replace("(", " (", 1).replace("call0 ()", "call0()")), ("c", "\n" * 20), ("d", "short")], "path string, src string")
    row = duplication.duplication_summary(df).first()
    assert (row.blocks, row.duplicated_lines, row.total_lines) == (3, 16, 38)
    assert duplication.duplication_summary(df.limit(0)).first().percentage == 0.0
    assert duplication.windows(df.where("path = 'c'")).count() == 0


LCOV = "TN:\nSF:a.java\nDA:1,1\nDA:2,0\nBRDA:1,0,0,1\nend_of_record\nDA:9,9\nSF:b.java\nDA:1,0\nSF:a.java\nDA:5,2\nend_of_record\n"
JACOCO = '<report><package name="p">\n<sourcefile name="A.java">\n<line nr="1" mi="0" ci="3"/>\n<line nr="2" mi="2" ci="0"/>\n</sourcefile>\n<line nr="9" mi="0" ci="1"/>\n</package></report>\n'


def test_coverage(spark, tmp_path):
    (tmp_path / "c.info").write_text(LCOV)
    (tmp_path / "c.xml").write_text(JACOCO)
    (tmp_path / "c.dat").write_text(JACOCO)
    rows = {(r.file, r.line, r.hits) for r in coverage.read_coverage(spark, str(tmp_path / "c.info")).collect()}
    assert rows == {("b.java", 1, 0), ("a.java", 5, 2)}  # of a file that comes twice the last record counts
    (tmp_path / "odd.lcov").write_text("SF:none.java\nend_of_record\nSF:x.java\nDA:1,-3\nDA: 2,1\nDA:3\nDA:4,7,sum\nDA:5,0\nDA:x,1\nend_of_record\nSF:last.java\nDA:1,99999999999999999999")
    odd = coverage.read_coverage(spark, str(tmp_path / "odd.lcov"))
    assert {(r.file, r.covered, r.uncovered, r.percentage) for r in coverage.file_coverage(odd).collect()} == {("none.java", 0, 0, 0.0), ("x.java", 1, 1, 50.0), ("last.java", 1, 0, 100.0)}
    assert {r.file for r in coverage.below(odd, 50).collect()} == {"none.java"}
    (tmp_path / "c.txt").write_text("neither")
    with pytest.raises(ValueError):
        coverage.read_coverage(spark, str(tmp_path / "c.txt"))
    (tmp_path / "t.txt").write_text("if a < b\nSF:a.java\nDA:1,1\n")
    assert coverage.read_coverage(spark, str(tmp_path / "t.txt")).first().file == "a.java"
    for name in ("c.xml", "c.dat"):
        report = coverage.read_coverage(spark, str(tmp_path / name))
        # a file's lines go on to the next file
        assert {(r.file, r.line, r.hits) for r in report.collect()} == {("A.java", 1, 3), ("A.java", 2, 0), ("A.java", 9, 1)}
    total = coverage.total_coverage(report, 66.0).first()
    assert round(total.percentage, 2) == 66.67 and total.passed and coverage.below(report, 66.0).count() == 0
    assert [r.line for r in coverage.uncovered(report, "A.java").collect()] == [2]
    assert coverage.total_coverage(report.limit(0), 10.0).first().percentage == 0.0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_records_over_blocks(spark, monkeypatch, block):
    """Lines belong to the record that is open before them, however far back it began."""
    monkeypatch.setattr(coverage, "BLOCK_LINES", block)
    values = ["DA:1,1", "SF:a", *[f"DA:{n},{n % 2}" for n in range(1, 30)], "end_of_record", "DA:77,1", "SF:b", "DA:1,1", "SF:c", "end_of_record", "SF:a", "DA:5,5"]
    text = spark.createDataFrame([(src, n, v) for src in "xy" for n, v in enumerate(values)], "source string, at long, value string")
    got = sorted((r.file, r.line or 0, r.hits) for r in coverage.lcov_lines(text).collect())
    assert got == sorted([("a", 5, 5), ("b", 1, 1), ("c", 0, None)] * 2)


def test_builds(spark, tmp_path):
    pom = lambda name, mods: f'<project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId>{name}</artifactId><modules>{"".join(f"<module>{m}</module>" for m in mods)}</modules></project>'
    for folder, text in {"m": pom("top", ["a", "plain", "gone", "x/deep", "bad", "unnamed"]), "m/a": pom("named-a", ["sub"]), "m/a/sub": pom("sub", [".."]), "m/bad": "<project><modules>", "m/unnamed": "<project/>"}.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "pom.xml").write_text(text)
    (tmp_path / "m/plain").mkdir()
    (tmp_path / "m/x/deep").mkdir(parents=True)
    found = builds.detect(str(tmp_path / "m"))
    assert {n: m.parent for n, m in found.items()} == {"top": None, "named-a": "top", "sub": "named-a", "..": "sub", "plain": "top", "x/deep": "top", "bad": "top", "root": "top"}
    assert found["top"].children == ["plain", "x/deep", "bad"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/pom.xml").write_text("<project><artifactId>x</project>")
    assert builds.detect(str(tmp_path / "broken")) == {}
    (tmp_path / "g/lib/core").mkdir(parents=True)
    (tmp_path / "g/app").mkdir()
    (tmp_path / "g/settings.gradle").write_text("rootProject.name = 'demo'\ninclude 'app', ':lib:core', \"gone\"\n")
    found = builds.detect(str(tmp_path / "g"))
    assert {n: m.parent for n, m in found.items()} == {"demo": None, "app": "demo", "core": "lib"}
    assert found["core"].path.endswith("g/lib/core") and found["demo"].children == ["app"]
    assert builds.detect(str(tmp_path)) == {} and builds.modules_table(spark, found).count() == 3


def test_modules(spark):
    issues = spark.createDataFrame([("/w/a/x.java", None), ("/w/ab/x.java", None), ("/w/a/b/x.java", None), ("/o/x.java", None)], "file string, module string")
    table = spark.createDataFrame([("w", "/w"), ("a", "/w/a"), ("b", "/w/a/b/"), ("none", "/x")], "name string, path string")
    placed = modules.assign(issues, table)
    assert {r.file: r.module for r in placed.collect()} == {"/w/a/x.java": "a", "/w/ab/x.java": "w", "/w/a/b/x.java": "b", "/o/x.java": None}
    assert modules.only(placed, include=["a"]).count() == 1 and modules.only(placed, exclude=["a"]).count() == 3
    assert {r.name: r.n for r in modules.counts(placed, table).collect()} == {"w": 1, "a": 1, "b": 1, "none": 0}


def test_settings(tmp_path):
    assert settings.config('max_params = 3\ndisabled_rules = ["S1"]\nother = 1') == Config(max_params=3, disabled_rules=("S1",))
    assert settings.config('{"max_nesting": 2}').max_nesting == 2
    assert settings.merge(Config(max_params=3, max_nesting=9), Config(max_nesting=2)) == Config(max_params=3, max_nesting=2)
    (tmp_path / "a/b").mkdir(parents=True)
    settings.write_template(str(tmp_path / "fathom.toml"))
    assert settings.discover(str(tmp_path / "a/b")) == Config()


@pytest.mark.parametrize(("name", "form"), [("txt", "text"), ("MD", "markdown"), ("codequality", "gitlab"), ("gitlab-code-quality", "gitlab"), ("pdf", None)])
def test_formats(name, form):
    assert reports.format_of(name) == form


def test_reports(spark, tmp_path, issues):
    n = issues.count()
    data = json.loads(reports.report(issues, "json", 3))
    assert data["summary"]["total_issues"] == n == len(data["issues"]) and sum(data["issues_by_severity"].values()) == n and set(data["issues"][0]) >= {"fix", "module", "cwe"}
    sarif = json.loads(reports.report(issues, "sarif", 3))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == n
    lab = json.loads(reports.report(issues, "gitlab", 3))
    assert len(lab) == n and all(len(x["fingerprint"]) == 16 and x["location"]["path"].startswith("src/") for x in lab)
    assert reports.report(issues, "csv", 3).splitlines()[0] == reports.CSV_HEADER and len(reports.report(issues, "csv", 3).splitlines()) == n + 1
    assert "&quot;hunter22&quot;" in reports.report(issues, "html", 3) and "hunter22" in reports.report(issues, "text", 3) and "| Line |" in reports.report(issues, "md", 3)
    reports.write(issues, "csv", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == n
    with pytest.raises(ValueError):
        reports.report(issues, "pdf", 3)


@pytest.mark.parametrize(("path", "want"), [("/w/src/a/src/b", "src/a/src/b"), ("src/a", "src/a"), ("/w/a", "/w/a"), ("/src/a", "/src/a"), ("/src/a/src/b", "src/b"), ("//src/a", "src/a")])
def test_relative_paths(spark, path, want):
    assert spark.range(1).select(reports.relative_path(F.lit(path)).alias("p")).first().p == want


def test_metrics(spark):
    df = spark.createDataFrame([("a", "// c\n\nclass A {\n * d\n  public int f(int n) { }\n}\n"), ("b", "")], "path string, src string")
    row = {r.path: r for r in metrics.source_metrics(df).collect()}
    assert tuple(row["a"])[1:] == (6, 3, 2, 1, 1, 1) and row["b"].total_lines == 0
    whole = re.compile(r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+)\s+\w+\s*\([^)]*\)\s*\{")
    texts = ["interface A {}", "enum B {}", "void f() {}", "new Foo() {", "if (x) {", "else if (x) {", "é ü(ß) {", "int f(a) throws E {", "a b c(d)\n {", "a b(c(d)) {", "static void f ( ) {} public static int g(){}", "subclass X", "class  Y", "a b(" * 50 + ") {"]
    got = {r.path: r for r in metrics.source_metrics(spark.createDataFrame([(t, t) for t in texts], "path string, src string")).collect()}
    assert {t: (got[t].classes, got[t].methods) for t in texts} == {t: (len(re.findall(r"\bclass\s+\w+", t)), len(whole.findall(t))) for t in texts}


def test_cache(spark):
    now = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 1)], "path string, modified long, size long")
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("z", 1, 1)], "path string, modified long, size long")
    split = metrics.cache_split(now, old)
    assert {r.path: r.hit for r in split.collect()} == {"a": True, "b": False, "c": False}
    assert metrics.cache_stats(split).first().hits == 1 and metrics.pruned(old, now).count() == 2
    issues = lambda *f: spark.createDataFrame([(x,) for x in f], "file string")
    assert sorted(r.file for r in metrics.cached_issues(issues("b"), issues("a", "b", "z"), split).collect()) == ["a", "b"]


def test_bursts(spark):
    t = datetime(2024, 1, 1)
    rows = [("a.java", t), ("a.java", t + timedelta(milliseconds=200)), ("a.java", t + timedelta(milliseconds=600)), ("b.java", t), ("c.txt", t)]
    df = watch.watched(spark.createDataFrame(rows, "path string, ts timestamp"))
    assert sorted((r.path, r.n) for r in watch.debounced_batch(df, 0.3).collect()) == sorted((r.path, r.n) for r in watch.debounced(df).collect()) == [("a.java", 1), ("a.java", 2), ("b.java", 1)]


def test_watching(spark, tmp_path, project):
    """Changes as a stream of files of rows; each burst's file is analysed again."""
    t = datetime(2024, 1, 1)
    source = tmp_path / "changes"
    spark.createDataFrame([(f"{project}/src/A.java", t), (f"{project}/src/A.java", t + timedelta(milliseconds=10)), ("late.java", t + timedelta(minutes=5))], "path string, ts timestamp").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(source))
    everything = files.scan(spark, str(project))
    running = watch.start(stream, lambda paths: everything.join(paths, "path"), lambda f: all_issues(f, Config(enabled_rules=("S106",))), str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    running.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.file.rpartition("/")[2], r.rule_id) for r in rows] == [("A.java", "S106")]
