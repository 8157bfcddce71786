"""Connected components of link tables, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.folders import shared_folder


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of a file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df``, written once in :func:`shared_folder`."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links(u, v)``: root is the smallest node reachable.

    Alternates two steps until nothing changes: every node tells its larger neighbours of the smallest node it
    knows, then its smaller ones.  Each step is a minimum by node, combined before the shuffle, and a join that
    adaptive execution can split, so a node with many links needs no task of its own.  Links that repeat, loops
    and empty tables are allowed.
    """
    edge = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = cut_lineage(links.where("u <> v").select(*edge(F.col("u"), F.col("v"))).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_least(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, order, least, root)`` of ``nodes(node, order)``, whose ``node`` are distinct and ``order`` never null.

    ``least`` is the smallest ``order`` that ``links(u, v)`` reach and ``root`` the node that has it, of several the
    smallest.  Components are found on names that begin with ``order``, so their smallest name is the answer and no join
    or group by component is left, however large one is.
    """
    named = nodes.select("node", F.struct("order", "node").alias("name"))
    ends = links.where("u <> v")
    for end in ("u", "v"):
        ends = ends.join(named.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name")), end)
    roots = connected_components(ends.select(F.col("u_name").alias("u"), F.col("v_name").alias("v")))
    roots = roots.select(F.col("node.node").alias("node"), F.col("root").alias("name"))
    return nodes.join(roots, "node", "left").select("node", "order", F.coalesce("name.order", "order").alias("least"), F.coalesce("name.node", "node").alias("root"))


def deal_groups(placed: DataFrame, keys: list[str], member: str, group_rows: int) -> DataFrame:
    """``placed`` with its groups made ready for a self-join by :func:`deal_parts`; only large groups are counted back."""
    sizes = placed.groupBy(*keys).count().where(F.col("count") > group_rows)
    sizes = sizes.select(*keys, F.col("count").alias("__rows"))
    return deal_parts(placed.join(sizes, keys, "left"), member, F.coalesce("__rows", F.lit(0)), group_rows).select(*placed.columns, "a", "b", "side")


def deal_parts(placed: DataFrame, member: str, rows: Column, group_rows: int) -> DataFrame:
    """``placed`` with its groups made ready for a self-join by tasks that see a bounded number of rows each.

    ``rows`` tells the size of a row's group.  Adds ``a, b, side``.  A group of up to ``group_rows`` rows stays whole, as
    (0, 0).  A larger one is divided into parts by a hash of ``member``, and every pair of parts is a cell (a, b) of its
    own: with a = b, for links within a part, and with a < b for those between side 0 and side 1.  So each pair of rows of
    a group meets in one cell.
    """
    parts = F.ceil(rows / group_rows).cast("int")
    part = F.pmod(F.xxhash64(member), parts).cast("int")
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side")))
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, part).alias("a"), F.greatest(o, part).alias("b"), (part > o).cast("int").alias("side")))
    return placed.withColumn("dealt_to", F.explode(F.when(rows <= group_rows, alone).otherwise(cells))).select("*", "dealt_to.*").drop("dealt_to")


def spanning_forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of 0..n-1, the smallest index that the links reach.  Links that repeat cost a look-up only."""
    sets, label = DisjointSets(n), np.arange(n)
    for i, j in links:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        fresh = np.unique(low[low != high] * n + high[low != high])
        if not len(fresh):
            continue
        for a, b in zip((fresh // n).tolist(), (fresh % n).tolist()):
            sets.join(a, b)
        label = np.array(sets.up)
        while ((up := label[label]) != label).any():
            label = up
    return label


class DisjointSets:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
