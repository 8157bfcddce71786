"""Marks in the source that take issues of their line out: ``// NOSONAR [ids] [- or : reason]``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import lines

#: Fixed value: the mark, the ids behind it and a reason.
MARK = r"//\s*NOSONAR\s*(?:([A-Za-z0-9,\s]+?))?(?:\s*[-:]\s*(.+))?$"


def mark_ids(text: Column) -> Column:
    """Ids of a line's mark, [] for all rules; null without a mark.

    Words behind the mark are ids, also those of a comment in plain words; other characters make the mark none.
    """
    ids = F.filter(F.split(F.regexp_extract(text, MARK, 1), r"[,\s]+"), lambda x: x != "")
    return F.when(text.contains("NOSONAR") & text.rlike(MARK), ids)


def held(ids: Column, rule_id: Column) -> Column:
    """Whether a mark's ids hold an issue of a rule back."""
    return F.coalesce((F.size(ids) == 0) | F.array_contains(ids, rule_id), F.lit(False)) & ids.isNotNull()


def line_mark(line: str) -> set[str] | None:
    """:func:`mark_ids` in Python."""
    if "NOSONAR" in line and (m := re.search(MARK, line)):
        return {x for x in re.split(r"[,\s]+", m[1] or "") if x}
    return None


def suppressions(files: DataFrame) -> DataFrame:
    """``(file, line, rule_ids array, reason)`` of every line with a mark; no ids means all rules."""
    cut = files.select("path", F.posexplode(lines(F.col("src"))).alias("at", "text")).where(F.col("text").contains("NOSONAR"))
    reason = F.regexp_extract("text", MARK, 2)
    marked = cut.select(F.col("path").alias("file"), (F.col("at") + 1).alias("line"), mark_ids(F.col("text")).alias("rule_ids"), F.when(reason != "", reason).alias("reason"))
    return marked.where("rule_ids is not null")


def unsuppressed(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Issues, from wherever, whose line has no mark for their rule.

    For issues that come with their files' lines, :func:`held` does without this join.
    """
    marks = suppressions(files).select(F.col("file").alias("mark_file"), F.col("line").alias("mark_line"), "rule_ids")
    same = (F.col("file") == F.col("mark_file")) & (F.col("line") == F.col("mark_line")) & held(F.col("rule_ids"), F.col("rule_id"))
    return issues.join(marks, same, "left_anti")
