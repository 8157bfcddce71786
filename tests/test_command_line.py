import json

from fathom.__main__ import parser, run

JAVA = 'package a;\nclass bad {\n  void f() { System.out.println("x"); }\n  String password = "hunter22";\n}\n'


def call(spark, *words):
    return run(spark, parser().parse_args(list(map(str, words))))


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "p/app").mkdir(parents=True)
    (tmp_path / "p/settings.gradle").write_text("rootProject.name = 'top'\ninclude 'app'\n")
    (tmp_path / "p/app/A.java").write_text(JAVA)
    project = tmp_path / "p"
    assert call(spark, "analyse", project, "--format", "json", "--enable", "S106") == 0
    issue = json.loads(capsys.readouterr().out)["issues"][0]
    assert issue["rule_id"] == "S106" and issue["module"] == "app"
    assert call(spark, "analyse", project, "--gate", "strict", "--format", "csv") == 1
    assert call(spark, "analyse", project, "--fail-on-severity", "blocker", "--disable", "S2068", "--enable", "S106") == 0
    assert call(spark, "analyse", project, "--compliance", "owasp") == 0
    assert "Injection" in capsys.readouterr().out
    assert call(spark, "baseline", project, "--out", tmp_path / "b") == 0 and call(spark, "diff", project, "--baseline", tmp_path / "b") == 0
    (project / "app/B.java").write_text(JAVA)
    assert call(spark, "diff", project, "--baseline", tmp_path / "b") == 1
    assert call(spark, "hotspots", project) == 1 and call(spark, "debt", project, "--max", 1) == 1 and call(spark, "duplication", project, "--min-lines", 3) == 0
    (tmp_path / "c.info").write_text("SF:a\nDA:1,1\nDA:2,0\nend_of_record\n")
    assert call(spark, "coverage", tmp_path / "c.info", "--threshold", 50) == 0 and call(spark, "coverage", tmp_path / "c.info", "--threshold", 51) == 1
    assert call(spark, "rules", "--category", "naming") == 0 and call(spark, "init", tmp_path / "fathom.toml") == 0
    assert (tmp_path / "fathom.toml").is_file() and "S101" in capsys.readouterr().out
