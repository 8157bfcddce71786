"""The generated corpus: where its texts are made."""

import pytest
from pyspark.sql import functions as F

from fathom.functions.text import lines
from fathom.operators.line_engine import file_lines
from fathom.plans.corpus import corpus


@pytest.mark.parametrize("read", [lambda files: files.where("src is not null"), file_lines, lambda files: files.select(F.explode(lines(F.col("src"))))], ids=["read", "lines", "texts"])
def test_no_text_is_made_in_the_scan_of_keys(spark, tmp_path, read):
    spark.range(120).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    files = read(corpus(spark, str(tmp_path)))
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "array_join" not in plan[plan.index("RepartitionByExpression") :]
    assert corpus(spark, str(tmp_path)).where("src is not null").count() == 120
