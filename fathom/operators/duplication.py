"""Copied code: runs of lines that occur more than once, over all files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import lines, trim

MIN_LINES = 6


def normalised(line, ignore_whitespace: bool = True, ignore_comments: bool = True):
    """A line without its comment (from the first ``//``, also in a text) and with single spaces."""
    out = trim(F.regexp_replace(line, r"(?U)\s+", " ")) if ignore_whitespace else line
    return trim(F.split(out, "//", -1)[0] if ignore_comments else out)


def windows(files: DataFrame, min_lines: int = MIN_LINES, **how) -> DataFrame:
    """``(file, start_line, end_line, hash)`` of every run of lines that isn't blank throughout.

    Runs are slices of the file's own array of lines, so they need no shuffle.
    """
    cut = files.select("path", F.transform(lines(F.col("src")), lambda x: normalised(x, **how)).alias("norm"))
    starts = F.when(F.size("norm") >= min_lines, F.sequence(F.lit(1), F.size("norm") - min_lines + 1)).otherwise(F.array().cast("array<int>"))
    runs = cut.select(F.col("path").alias("file"), "norm", F.explode(starts).alias("start_line"))
    text = F.array_join(F.slice("norm", F.col("start_line"), min_lines), "\n")
    made = runs.select("file", "start_line", (F.col("start_line") + min_lines - 1).alias("end_line"), text.alias("text"))
    return made.where(F.length(F.regexp_replace("text", "\n", "")) > 0).select("file", "start_line", "end_line", F.md5("text").alias("hash"))


def duplicate_blocks(files: DataFrame, min_lines: int = MIN_LINES, **how) -> DataFrame:
    """``(hash, n)`` of runs that occur more than once; blocks that overlap stay apart."""
    return windows(files, min_lines, **how).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_places(files: DataFrame, min_lines: int = MIN_LINES, **how) -> DataFrame:
    """``(hash, file, start_line, end_line)`` of every occurrence.

    The hashes that repeat are counted before they are joined, so a run with very many places isn't gathered anywhere.
    """
    runs = windows(files, min_lines, **how)
    return runs.join(runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hash", "left_semi")


def duplication_summary(files: DataFrame, min_lines: int = MIN_LINES, **how) -> DataFrame:
    """One row: blocks, distinct lines in any of them, all lines, and their share in per cent."""
    places = duplicate_places(files, min_lines, **how)
    # each place's lines and its hash as rows of one kind, so the places are found once
    line = F.transform(F.sequence("start_line", "end_line"), lambda n: F.struct(F.col("file").alias("name"), n.alias("line")))
    named = places.select(F.explode(F.concat(line, F.array(F.struct(F.col("hash").alias("name"), F.lit(0).alias("line"))))).alias("x")).select("x.*").distinct()
    found = named.agg(F.count_if(F.col("line") == 0).alias("blocks"), F.count_if(F.col("line") > 0).alias("duplicated_lines"))
    whole = files.agg(F.coalesce(F.sum(F.size(lines(F.col("src"))).cast("long")), F.lit(0)).alias("total_lines"))
    share = F.when(F.col("total_lines") > 0, F.col("duplicated_lines") * 100.0 / F.col("total_lines")).otherwise(0.0)
    one_row = F.broadcast(whole.withColumn("k", F.lit(1)))
    return found.withColumn("k", F.lit(1)).join(one_row, "k").select("blocks", "duplicated_lines", "total_lines", share.alias("percentage"))
