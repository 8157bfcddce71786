import json
import os

import fathom
from fathom.operators import baseline, cache
from fathom.plans.analysis import Config, all_issues
from fathom.sinks import reports
from fathom.sources import files
from fathom.streaming import watch
from tests.test_command_line import JAVA, call

CONFIG = Config(enabled_rules=("S106", "S2068"))


def place(root, **sources):
    root.mkdir(exist_ok=True)
    for name, text in sources.items():
        (root / f"{name}.java").write_text(text)
        os.utime(root / f"{name}.java", (1_700_000_000, 1_700_000_000))


def keys(issues):
    return sorted((r.file.rpartition("/")[2], r.rule_id, r.line) for r in issues.collect())


def test_cache(spark, tmp_path):
    project, folder = tmp_path / "p", str(tmp_path / "cache")
    place(project, A=JAVA, B=JAVA)
    assert cache.load(spark, folder, CONFIG).files.count() == 0
    now, stats = cache.analyse(spark, str(project), cache.load(spark, folder, CONFIG), CONFIG)
    assert tuple(stats.first()) == (0, 2, 0.0)
    cache.save(now, folder, CONFIG)
    first = cache.load(spark, folder, CONFIG)
    assert cache.entries(first) == (2, 4) and keys(first.issues) == keys(all_issues(files.scan(spark, str(project)), CONFIG))
    # one file is another, one is new, and one is as it was, though the cache says otherwise of it
    place(project, B="class B { }\n", C=JAVA)
    now, stats = cache.analyse(spark, str(project), first, CONFIG)
    assert (stats.first().hits, stats.first().misses) == (1, 2)
    cache.save(now, folder, CONFIG)
    then = cache.load(spark, folder, CONFIG)
    assert keys(then.issues) == [(f, r, n) for f in ("A.java", "C.java") for r, n in (("S106", 3), ("S2068", 4))]
    assert len(os.listdir(folder)) - sum(n.startswith(".") for n in os.listdir(folder)) == 2  # one set of tables
    (project / "C.java").unlink()
    assert cache.entries(cache.prune(then, files.listing(spark, str(project)))) == (2, 2)
    gone = spark.createDataFrame([(f"{project}/A.java",)], "path string")
    assert cache.entries(cache.invalidate(then, gone)) == (2, 2)
    other = Config(enabled_rules=("S106",))
    assert cache.config_hash(CONFIG) != cache.config_hash(other) and cache.entries(cache.load(spark, folder, other)) == (0, 0)
    (tmp_path / "cache/cache.json").write_text("{")
    assert cache.describe(spark, folder) is None
    cache.clear(spark, folder)
    assert not (tmp_path / "cache").exists()


def test_ready_files(spark):
    listing = spark.createDataFrame([("same", 10, 1), ("old", 10, 2), ("new", 10, 1), ("busy", 99, 1)], "path string, modified long, size long")
    known = spark.createDataFrame([("same", 10, 1), ("old", 10, 1), ("busy", 10, 1), ("gone", 1, 1)], "path string, modified long, size long")
    assert sorted(r.path for r in watch.ready(listing, known, 99.2, 0.3).collect()) == ["new", "old"]


def test_following_a_folder(spark, tmp_path):
    project = tmp_path / "p"
    place(project, A=JAVA)
    steps = watch.follow(spark, str(project), lambda f: all_issues(f, CONFIG), lambda: files.scan(spark, str(project)), lambda: files.listing(spark, str(project)), every=0.01, rounds=3)
    kind, issues = next(steps)
    assert kind == "initial" and len(keys(issues)) == 2
    place(project, B=JAVA)
    kind, issues = next(steps)
    assert kind == "changed" and {f for f, _, _ in keys(issues)} == {"B.java"}
    assert list(steps) == []  # nothing has changed since


def test_baseline_documents(spark, tmp_path):
    place(tmp_path / "p", A=JAVA)
    issues = all_issues(files.scan(spark, str(tmp_path / "p")), CONFIG)
    baseline.save(issues, str(tmp_path / "b"), "first run")
    told = baseline.about(spark, str(tmp_path / "b"))
    assert told["version"] == "1.0" and told["description"] == "first run" and told["created_at"]
    text = "".join(baseline.document(issues, "as one"))
    data = json.loads(text)
    assert data["description"] == "as one" and [f["rule_id"] for f in data["fingerprints"]] and len(data["fingerprints"]) == 2
    (tmp_path / "one.json").write_text(text)
    then = baseline.load(spark, str(tmp_path / "one.json"))
    assert baseline.new(issues, then).count() == 0 and baseline.about(spark, str(tmp_path / "one.json"))["description"] == "as one"
    assert json.loads("".join(baseline.document(issues.limit(0))))["fingerprints"] == []


def test_streamed_documents(spark, tmp_path):
    place(tmp_path / "p", A=JAVA, B=JAVA)
    issues = all_issues(files.scan(spark, str(tmp_path / "p")), CONFIG)
    sarif = json.loads("".join(reports.document(issues, "sarif")))
    assert len(sarif["runs"][0]["results"]) == 4 and sarif["$schema"] == reports.SARIF_SCHEMA
    assert len(json.loads("".join(reports.document(issues, "gitlab")))) == 4
    assert json.loads("".join(reports.document(issues.limit(0), "sarif")))["runs"][0]["results"] == []
    assert reports.summary(issues, 2).splitlines()[:2] == ["Files: 2", "Issues: 4"]


def test_new_commands(spark, tmp_path, capsys):
    place(tmp_path / "p", A=JAVA)
    folder, out = tmp_path / "c", tmp_path / "out.sarif"
    for hits in (0, 1):
        assert call(spark, "analyse", tmp_path / "p", "--cache", "--cache-file", folder, "--show-cache-stats", "--format", "sarif", "--output", out, "--enable", "S106") == 0
        assert f"{hits} hits" in capsys.readouterr().err and len(json.loads(out.read_text())["runs"][0]["results"]) == 1
    assert call(spark, "analyse", tmp_path / "p", "--summary-only", "--verbose", "--max-nesting", 2, "--min-severity", "blocker") == 0
    told = capsys.readouterr()
    assert "blocker: " in told.out and "rules are active" in told.err and "[S" not in told.out
    (tmp_path / "rules.yaml").write_text("rules:\n  - id: 5\n")
    assert call(spark, "analyse", tmp_path / "p", "--custom-rules", tmp_path / "rules.yaml", "--summary-only") == 0
    assert "no custom rules" in capsys.readouterr().err
    assert call(spark, "analyse", tmp_path / "p/A.java", "--enable", "S106", "--format", "csv") == 0 and "S106" in capsys.readouterr().out
    assert call(spark, "watch", tmp_path / "p", "--rounds", 1, "--cache", "--cache-file", folder) == 0 and "initial analysis" in capsys.readouterr().out
    assert call(spark, "baseline", tmp_path / "p", "--out", tmp_path / "b.json", "--description", "d") == 0
    assert call(spark, "diff", tmp_path / "p", "--baseline", tmp_path / "b.json", "--format", "json") == 0
    assert json.loads(capsys.readouterr().out)["new"] == 0
    assert call(spark, "debt", tmp_path / "p", "--format", "json") == 0 and json.loads(capsys.readouterr().out)
    assert call(spark, "hotspots", tmp_path / "p", "--format", "json") == 1 and json.loads(capsys.readouterr().out)[0]["priority"]
    assert call(spark, "version") == 0 and "987 rules" in capsys.readouterr().out
    assert call(spark, "rules", "--category", "secur", "--details") == 0 and "CWE-" in capsys.readouterr().out


def test_exports():
    for name in fathom.__all__:
        assert callable(getattr(fathom, name)) or name == "GATES"
