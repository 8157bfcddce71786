"""Coverage of long traces: what is read and sent, and lines that stand in a trace twice or whose numbers have gaps."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.operators import coverage
from fathom.plans import queries
from tests.test_coverage_reports import brute_trace, rows, trace

ORDERS = 20_000


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """Line items: two of an order, some twice in the table, some with the same number from another supplier."""
    folder = tmp_path_factory.mktemp("items")
    k = F.col("id")
    table = spark.range(ORDERS * 2).select(F.floor(k / 2).alias("l_orderkey"), (k % 2 * 4 + 3).cast("int").alias("l_linenumber"), (F.hash(k) % 50 + 50).cast("bigint").alias("l_suppkey"))
    table = table.union(table.where("l_orderkey % 3 = 0")).union(table.where("l_orderkey % 4 = 0").withColumn("l_suppkey", F.col("l_suppkey") + 1)).repartition(5)
    table.coalesce(1).write.parquet(str(folder / "lineitem.parquet"))
    return folder, table.count()


def stages(spark):
    none = spark._jvm.java.util.ArrayList()
    found = spark._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return {s.stageId(): (s.inputRecords(), s.shuffleWriteRecords()) for s in map(found.apply, range(found.size()))}


@pytest.mark.parametrize("name", ["coverage_below", "coverage_gaps", "coverage_total", "coverage_files"])
def test_only_blocks_of_last_records_are_sent(spark, items, name):
    folder, n = items
    before = stages(spark)
    got = rows(queries.QUERIES[name](spark, str(folder)))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [v for k, v in stages(spark).items() if k not in before]
    read, sent = map(sum, zip(*new))
    assert read == 3 * n  # for the last records, for the table of blocks, and for their lines
    assert sent < 2 * n  # the trace has seven lines an item
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
        assert got == Counter(db.sql(queries.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("numbers", [1, 400, None])
def test_copies_and_gaps(spark, numbers):
    lines = trace(random.Random(5), 300)
    text = spark.createDataFrame([("r", n * 137, v) for n, v in enumerate(lines)], "source string, at long, value string")
    want = brute_trace(lines)
    assert rows(coverage.lcov_lines(text, numbers)) == want
    assert rows(coverage.lcov_lines(text.union(text).repartition(5), numbers, repeated=True)) == want


def test_lines_below(spark):
    covered = [("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("b", 1, 1), ("b", 2, 0), ("c", None, None), ("d", 9, 0)]
    covered = spark.createDataFrame(covered, "file string, line long, hits long")
    assert rows(coverage.uncovered_below(covered, 50)) == Counter([("a", 1), ("a", 2), ("d", 9)])
