"""Coverage of reports that are read in splits, and of random ones, against a parser that goes through them line by line."""

import random
import re
from collections import Counter

import pytest

from fathom.operators import coverage


def brute_trace(lines):
    files, name, found = {}, None, []
    for line in map(str.strip, lines):
        if line.startswith("SF:"):
            name, found = line[3:], []
        elif line == "end_of_record":
            name = None
        elif name and (m := re.fullmatch(r"DA:(\d+),(\d+)(,.*)?", line)):
            found.append((int(m[1]), int(m[2])))
        if name:
            files[name] = found
    return Counter((f, *row) for f, rows in files.items() for row in (rows or [(None, None)]))


def brute_xml(lines):
    files, name = {}, None
    for line in lines:
        if "<sourcefile" in line and (m := re.search(r'name="([^"]*)"', line)):
            name = m[1]
            files[name] = []
        elif name and "<line" in line and (m := re.search(r'nr="(\d+)"', line)) and int(m[1]) > 0:
            ci = re.search(r'ci="(\d+)"', line)
            files[name].append((int(m[1]), int(ci[1]) if ci else 0))
    return Counter((f, *row) for f, rows in files.items() for row in (rows or [(None, None)]))


def trace(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(["SF:src/F%d.java" % rng.randrange(12), "end_of_record", "SF:", "BRDA:1,0,0,1", "DA:x,1", "DA:3", "TN:"] + ["DA:%d,%d" % (rng.randint(1, 9), rng.randrange(3))] * 8 + [" DA:7,1,abc "]))
    return out


def xml(rng, n):
    return [rng.choice(['<sourcefile name="F%d.java">' % rng.randrange(9), "</sourcefile>", '<method name="m"/>', '<line nr="0" ci="1"/>', "<line/>"] + ['  <line nr="%d" mi="0" ci="%d"/>' % (rng.randint(1, 9), rng.randrange(3))] * 7) for _ in range(n)]


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_numbered_lines(spark, monkeypatch, seed, block):
    monkeypatch.setattr(coverage, "BLOCK_LINES", block)
    rng = random.Random(seed)
    for make, read, brute in ((trace, coverage.lcov_lines, brute_trace), (xml, coverage.jacoco_lines, brute_xml)):
        reports = {"r1": make(rng, 120), "r2": make(rng, 60), "r3": make(rng, 0)}
        text = spark.createDataFrame([(k, n, v) for k, lines in reports.items() for n, v in enumerate(lines)], "source string, at long, value string")
        assert rows(read(text.repartition(5))) == sum(map(brute, reports.values()), Counter())


@pytest.mark.parametrize("name, make, brute", [("t.info", trace, brute_trace), ("r.xml", xml, brute_xml), ("t.txt", trace, brute_trace), ("x.txt", lambda rng, n: ['<?xml version="1.0"?>', *xml(rng, n)], brute_xml)])
def test_split_reads(spark, tmp_path, name, make, brute):
    lines = make(random.Random(7), 6000)
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    want = brute(lines)
    assert sum(want.values()) > 9
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert coverage.report_lines(spark, str(tmp_path / name)).select("block").distinct().count() > 8
        assert rows(coverage.read_coverage(spark, str(tmp_path / name))) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_windows_of_lines_in_the_plan(spark):
    text = spark.createDataFrame([("r", 0, "SF:a"), ("r", 1, "DA:1,1")], "source string, at long, value string")
    plan = coverage.lcov_lines(text)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bWindow \[", plan)) == 2  # one over lines, one over the table of blocks
