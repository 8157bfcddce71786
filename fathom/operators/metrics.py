"""Size of sources, and which files a run can take from an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import lines, trim

#: What counts as a class, and the end of what counts as a method.  A method may have a visibility and ``static``
#: before its type; as neither is needed, a match is there for every type's last letter before a name and brackets.
CLASS = r"\bclass\s+\w+"
METHOD_END = r"\w\s++\w++\s*+\([^)]*+\)\s*+\{"


def _count(text: Column, pattern: str) -> Column:
    """Matches, with Unicode classes in texts that need them."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.regexp_count(text, F.lit("(?U)" + pattern))).otherwise(F.regexp_count(text, F.lit(pattern))).cast("long")


def source_metrics(files: DataFrame) -> DataFrame:
    """``(path, total_lines, code_lines, comment_lines, blank_lines, classes, methods)``; null where the file couldn't be read."""
    cut = files.select("path", "src", F.transform(lines(F.col("src")), trim).alias("t"))
    comment = lambda t: t.startswith("//") | t.startswith("/*") | t.startswith("*")
    n = {"total_lines": F.size("t"), "comment_lines": F.size(F.filter("t", comment)), "blank_lines": F.size(F.filter("t", lambda t: t == ""))}
    counted = cut.select("path", "src", *[c.cast("long").alias(k) for k, c in n.items()])
    return counted.select("path", "total_lines", (F.col("total_lines") - F.col("comment_lines") - F.col("blank_lines")).alias("code_lines"), "comment_lines", "blank_lines", _count(F.col("src"), CLASS).alias("classes"), _count(F.col("src"), METHOD_END).alias("methods"))


def cache_split(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """``listing(path, modified, size)`` with ``hit``: whether the cache has the same path, second and size."""
    c = cached.select("path", F.col("modified").alias("c_modified"), F.col("size").alias("c_size"))
    return listing.join(c, "path", "left").withColumn("hit", F.coalesce((F.col("modified") == F.col("c_modified")) & (F.col("size") == F.col("c_size")), F.lit(False))).select(*listing.columns, "hit")


def cache_stats(split: DataFrame) -> DataFrame:
    counts = split.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    whole = F.col("hits") + F.col("misses")
    return counts.withColumn("hit_rate", F.when(whole > 0, F.col("hits") * 100.0 / whole).otherwise(0.0))


def pruned(cached: DataFrame, listing: DataFrame) -> DataFrame:
    """Cache rows whose path is still there."""
    return cached.join(listing, "path", "left_semi")


def cached_issues(fresh: DataFrame, cached: DataFrame, split: DataFrame) -> DataFrame:
    """Issues of a run: those found anew, and for files that didn't change those of the cache."""
    kept = cached.join(split.where("hit").select(F.col("path").alias("file")), "file", "left_semi")
    return fresh.unionByName(kept)
