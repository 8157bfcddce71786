"""Modules of a build, and the module of each file."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Modules that are sent to every task, to be looked up there; more are joined.
SENT_MODULES = 100_000


def lookup(modules: DataFrame) -> Callable[[Column], Column] | None:
    """A function from a path to the name of the module whose path is its longest prefix, by whole path components.

    The modules' paths are one table in each task, in which a path's prefixes are looked up, the longest first.  None if there
    are more modules than are sent to tasks.  Of modules with the same path the one with the largest name counts.
    """
    rows = modules.select("name", F.regexp_replace("path", "/+$", "").alias("path")).where("path is not null").limit(SENT_MODULES + 1).collect()
    if len(rows) > SENT_MODULES:
        return None
    known = {r.path: r["name"] for r in sorted(rows, key=lambda r: r["name"] or "")}

    def of(path: str | None) -> str | None:
        while path is not None:
            if path in known:
                return known[path]
            path = path.rpartition("/")[0] if "/" in path else None
        return None

    @F.arrow_udf("string")
    def module(paths: pa.Array) -> pa.Array:
        return pa.array(map(of, paths.to_pylist()), pa.string())

    return module


def joined(files: DataFrame, modules: DataFrame, name: str = "path") -> DataFrame:
    """``(path, module)`` of the paths that lie in a module, by an equi-join of each path's own prefixes with the modules'."""
    parts = F.split("path", "/")
    prefixes = files.select(F.col(name).alias("path")).distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("prefix")))).alias("p")).select("path", "p.*")
    known = modules.select("name", F.regexp_replace("path", "/+$", "").alias("prefix"))
    return prefixes.join(known, "prefix").groupBy("path").agg(F.max_by("name", F.struct("depth", "name")).alias("module"))


def assign(issues: DataFrame, modules: DataFrame) -> DataFrame:
    """Issues from wherever, with their module; those that a run finds get it from their file (see :func:`with_module`)."""
    if of := lookup(modules):
        return issues.withColumn("module", of(F.col("file"))).select(*issues.columns)
    best = joined(issues, modules, "file").select(F.col("path").alias("file"), F.col("module").alias("found"))
    return issues.join(best, "file", "left").withColumn("module", F.col("found")).select(*issues.columns)


def with_module(files: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``files`` with a column ``module``, looked up once a file; with too many modules for that, ``files`` as they are and a
    table ``(path, module)`` that is made from the paths alone."""
    if of := lookup(modules):
        return files.withColumn("module", of(F.col("path"))), None
    return files, joined(files, modules)


def only(issues: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Issues of some modules; those of none go when modules are named, and stay when modules are excluded."""
    if include:
        issues = issues.where(F.col("module").isin(*include))
    if exclude:
        issues = issues.where(F.col("module").isNull() | ~F.col("module").isin(*exclude))
    return issues


def counts(issues: DataFrame, modules: DataFrame) -> DataFrame:
    """Every module with its number of issues, 0 included."""
    n = issues.groupBy("module").agg(F.count("*").alias("n"))
    return modules.join(n, modules["name"] == n["module"], "left").select("name", "path", F.coalesce("n", F.lit(0)).alias("n"))
