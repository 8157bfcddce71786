"""Modules and coverage of files with deep and long paths."""

from fathom.operators import coverage, modules


def test_modules_of_any_depth(spark):
    deep = "/".join(f"d{n}" for n in range(100))
    issues = spark.createDataFrame([(f"{deep}/A.java", None), ("d0/B.java", None), ("C.java", None), (None, None)], "file string, module string")
    known = spark.createDataFrame([("deep", f"{deep}/"), ("top", "d0")], "name string, path string")
    assert {r.file: r.module for r in modules.assign(issues, known).collect()} == {f"{deep}/A.java": "deep", "d0/B.java": "top", "C.java": None, None: None}


def test_traces_of_files_with_long_names(spark):
    name = "d/" * 6000 + "A.java"
    text = spark.createDataFrame([("t", n, v) for n, v in enumerate([f"SF:{name}", f"DA:{'0' * 12_000}7,3", "end_of_record"])], "source string, at int, value string")
    assert [tuple(r) for r in coverage.lcov_lines(text).collect()] == [(name, 7, 3)]
