"""An analysis cache: what was found in each file, with the time and size that the file had then.

A cache is a folder with a table of files, a table of issues and a description.  Each save writes new tables beside those
in use and then points the description at them, so a run that is lost leaves the cache as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import fields
from hashlib import sha256
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.metrics import cache_split, cache_stats, cached_issues, pruned
from fathom.plans.analysis import FIX, Config, all_issues
from fathom.sources import files as sources

#: Version of the format, and of what is found; a cache of another one isn't used.
FORMAT, ANALYZER = "1.0", "0.2.0"
DEFAULT = ".fathom/cache"
FILES = "path string, modified long, size long, cached_at long"
ISSUES = f"rule_key string, rule_id string, title string, severity string, severity_rank int, category string, file string, line int, column int, end_line int, end_column int, message string, code_snippet string, owasp string, cwe int, debt_minutes int, module string, fix {FIX}, rule_ord int"


class Cache(NamedTuple):
    files: DataFrame
    issues: DataFrame


def config_hash(config: Config) -> int:
    """A number for the settings that findings depend on."""
    told = {f.name: getattr(config, f.name) for f in fields(config) if f.name not in ("output_format", "fail_on_severity")}
    return int(sha256(repr(sorted(told.items())).encode()).hexdigest()[:15], 16)


def empty(spark: SparkSession) -> Cache:
    return Cache(spark.createDataFrame([], FILES), spark.createDataFrame([], ISSUES))


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def describe(spark: SparkSession, folder: str) -> dict | None:
    """The description of a cache; None if there is none that can be read."""
    path, system = _path(spark, f"{folder}/cache.json")
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    except (ValueError, Py4JJavaError):  # cut off, or not what its checksum says
        return None
    finally:
        stream.close()


def compatible(about: dict | None, config: Config) -> bool:
    """Whether a cache was made by the same analyzer with the same settings."""
    return about is not None and about.get("version") == FORMAT and about.get("analyzer_version") == ANALYZER and about.get("config_hash") == config_hash(config)


def load(spark: SparkSession, folder: str, config: Config = Config()) -> Cache:
    """The cache in a folder, or an empty one where there is none or it isn't compatible."""
    about = describe(spark, folder)
    if not compatible(about, config):
        return empty(spark)
    return Cache(spark.read.schema(FILES).parquet(f"{folder}/{about['tables']}/files"), spark.read.schema(ISSUES).parquet(f"{folder}/{about['tables']}/issues"))


def save(cache: Cache, folder: str, config: Config = Config()) -> None:
    """Write a cache; tables that it no longer points at are deleted."""
    spark = cache.files.sparkSession
    before, tables = describe(spark, folder), f"tables-{uuid.uuid4().hex}"
    cache.files.write.parquet(f"{folder}/{tables}/files")
    cache.issues.write.parquet(f"{folder}/{tables}/issues")
    about = {"version": FORMAT, "analyzer_version": ANALYZER, "config_hash": config_hash(config), "saved_at": int(time.time()), "tables": tables}
    path, system = _path(spark, f"{folder}/cache.json")
    out = system.create(path, True)
    out.write(bytearray(json.dumps(about), "utf-8"))
    out.close()
    if before and before.get("tables"):
        old, _ = _path(spark, f"{folder}/{before['tables']}")
        system.delete(old, True)


def clear(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def invalidate(cache: Cache, paths: DataFrame) -> Cache:
    """The cache without the files of ``paths(path)``."""
    return Cache(cache.files.join(paths, "path", "left_anti"), cache.issues.join(paths.withColumnRenamed("path", "file"), "file", "left_anti"))


def prune(cache: Cache, listing: DataFrame) -> Cache:
    """The cache without files that aren't there any more."""
    there = listing.select("path")
    return Cache(pruned(cache.files, there), cache.issues.join(there.withColumnRenamed("path", "file"), "file", "left_semi"))


def entries(cache: Cache) -> tuple[int, int]:
    """Numbers of files and of issues that the cache has."""
    return cache.files.count(), cache.issues.count()


def analyse(spark: SparkSession, folder: str, cache: Cache, config: Config = Config()) -> tuple[Cache, DataFrame]:
    """The cache that a run over a folder leaves, whose issues are the run's, and its hits and misses.

    A file is taken from the cache if its path, second of change and size are the same.  Only the others' rules are run.
    """
    listing = sources.listing(spark, folder, config.exclude_patterns)
    split = cache_split(listing, cache.files)
    changed = split.where(~F.col("hit"))
    fresh = all_issues(sources.scan(spark, folder, config.exclude_patterns).join(changed.select("path"), "path", "left_semi"), config)
    kept = cache.files.join(split.where("hit").select("path"), "path", "left_semi")
    now = changed.select("path", "modified", "size", F.lit(int(time.time())).cast("long").alias("cached_at"))
    return Cache(kept.unionByName(now), cached_issues(fresh, cache.issues, split)), cache_stats(split)
