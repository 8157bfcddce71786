"""Operator 12: whitening of embeddings by a tiled covariance.

Vectors become vectors of integers, of which each distinct one counts once.  Their dimensions are divided into blocks of
``TILE``, and every pair of blocks is a tile of the covariance.  A task that reads a block of rows cuts it into column
blocks and sends each to the tiles that need it, by tile and block of rows; there the two column blocks are centred and
multiplied, and the products are summed per tile, first in ``SLOTS`` places for each tile and then by tile.  Only the
covariance itself reaches the driver, whose size follows the number of dimensions and not the number of rows; it is
decomposed there, and the few components go to all rows.

Sums are of integers, and values are centred as integers as far as they can be, so nothing is lost to rounding before the
multiplication.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.folders import shared_folder
from fathom.llm.batches import map_batches, quoted
from fathom.llm.graph import delete

#: Steps to which an entry is rounded down, and what is added to them.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are taken as this.
LARGEST = 1e15
#: Dimensions of a tile's side, rows of a block, and places in which a tile's products are summed at first.
TILE, BLOCK_ROWS, SLOTS = 64, 2048, 64
#: Most dimensions: the covariance of so many takes half a gigabyte of the driver.
MOST_DIMENSIONS = 8192
COMPONENTS = 16
#: Components with a smaller share of the largest eigenvalue than this, by dimension, are rounding errors.
ROUNDING = 1e-13
#: Groups in which tasks' moments are merged before the driver does.
MERGE = 64


@dataclass
class Whitening:
    """What whitening takes: ``whitened = ((x - mean) @ vectors) / sqrt(values)``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centre(x, self.n, self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; not a number where the component has no variance."""
        scale = np.full(len(self.values), np.nan)
        scale[self.sound] = 1 / np.sqrt(self.values[self.sound])
        return (self.centred(x) @ self.vectors) * scale

    @property
    def sound(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        return self.values > ROUNDING * len(self.sums) * max(self.values.max(initial=0.0), 0.0)


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``: the whole part of the mean is subtracted from integers, and its fraction from what is left."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def integers(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with a column ``x array<long>``: ``floor(64 c) + 1000000`` of each entry ``c`` as a double.

    Rows go whose vector is null or empty or holds null or non-finite entries.
    """
    name = F.col(quoted(vector_col))
    bad = F.exists(name, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    clipped = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform(name, lambda c: F.floor(clipped(c) * SCALE) + SHIFT)
    return vectors.where(name.isNotNull() & (F.size(name) > 0) & ~bad).withColumn("x", x)


def _matrix(column: list[list[int]]) -> np.ndarray:
    return np.array(column, dtype=np.int64)


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of ``fit(x)`` and the exact sum of each dimension."""

    def task(parts):
        n, sums = 0, None
        for (xs,) in parts:
            part = _matrix(xs).astype(object).sum(axis=0) if max(map(max, xs)) > 2**40 or min(map(min, xs)) < -(2**40) else _matrix(xs).sum(axis=0)
            n, sums = n + len(xs), [int(a) for a in part] if sums is None else [a + int(b) for a, b in zip(sums, part)]
        if n:
            yield [[n] * len(sums), list(range(len(sums))), [str(s) for s in sums]]

    partial = map_batches(fit, ["x"], "n long, dimension int, total string", task)
    rows = partial.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = {r.dimension: int(r.total) for r in rows}
    return (rows[0].n if rows else 0), [sums[d] for d in range(len(sums))]


def _packed(block: np.ndarray) -> bytes:
    """A block of integers in the smallest type that holds it, named by the first byte."""
    for kind in ("b", "h", "i"):
        small = block.astype(kind)
        if (small == block).all():
            return kind.encode() + small.tobytes()
    return b"q" + block.astype("q").tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=chr(data[0]), offset=1).reshape(-1, width).astype(np.float64)


def _sum_keys(parts: Iterable[list[list]]) -> Iterator[list]:
    """Sums of arrays that stand beside equal keys (i, j, slot), which come one after the other."""
    key, total = None, None
    for i, j, slot, data in parts:
        for *now, product in zip(i, j, slot, data):
            if now != key:
                if key is not None:
                    yield [[v] for v in (*key, total.tobytes())]
                key, total = now, np.zeros(len(product) // 8)
            total += np.frombuffer(product)
    if key is not None:
        yield [[v] for v in (*key, total.tobytes())]


def tiled_covariance(fit: DataFrame, n: int, sums: list[int], tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Covariance of ``fit(x)``, whose ``n`` rows have the sums ``sums``; divisor ``n``, centred before multiplying."""
    dims = len(sums)
    edges = list(range(0, dims, tile)) + [dims]
    blocks = len(edges) - 1
    whole = np.array([s // n for s in sums], dtype=np.int64)
    fraction = np.array([s % n / n for s in sums])

    def cut(parts):
        partition, number = TaskContext.get().partitionId(), 0
        for (xs,) in parts:
            x = _matrix(xs) - whole
            columns = [_packed(x[:, a:b]) for a, b in zip(edges, edges[1:])]
            for i in range(blocks):
                others = blocks - i
                yield [[i] * others, list(range(i, blocks)), [partition << 32 | number] * others, [columns[i]] * others, [None, *columns[i + 1 :]]]
            number += 1

    sent = map_batches(fit, ["x"], "i int, j int, row_block long, left_block binary, right_block binary", cut, rows=block_rows)
    sent = sent.withColumn("slot", F.pmod(F.xxhash64("row_block"), F.lit(SLOTS)).cast("int"))
    sent = sent.repartition("i", "j", "slot").sortWithinPartitions("i", "j", "slot", "row_block")

    def multiply(parts):
        def products():
            for i, j, slot, left, right in parts:
                for a, b, s, one, other in zip(i, j, slot, left, right):
                    first = _unpacked(one, edges[a + 1] - edges[a]) - fraction[edges[a] : edges[a + 1]]
                    second = first if other is None else _unpacked(other, edges[b + 1] - edges[b]) - fraction[edges[b] : edges[b + 1]]
                    yield [[a], [b], [s], [(first.T @ second).tobytes()]]

        yield from _sum_keys(products())

    placed = map_batches(sent, ["i", "j", "slot", "left_block", "right_block"], "i int, j int, slot int, product binary", multiply, rows=1)

    def add_up(parts):
        yield from _sum_keys([i, j, [0] * len(i), data] for i, j, data in parts)

    tiles = map_batches(placed.repartition("i", "j").sortWithinPartitions("i", "j", "slot"), ["i", "j", "product"], "i int, j int, slot int, product binary", add_up)
    covariance = np.zeros((dims, dims))
    for r in tiles.toLocalIterator():
        a, b = slice(edges[r.i], edges[r.i + 1]), slice(edges[r.j], edges[r.j + 1])
        covariance[a, b] = np.frombuffer(r["product"]).reshape(a.stop - a.start, -1) / n
        covariance[b, a] = covariance[a, b].T
    return covariance


def decompose(covariance: np.ndarray, n: int, sums: list[int], components: int = COMPONENTS) -> Whitening:
    """The components with the largest eigenvalues; each one's entry of the largest size is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:components], 0.0), vectors[:, ::-1][:, :components]
    peaks = np.abs(vectors).argmax(axis=0)
    signs = np.where(vectors[peaks, np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, vectors * signs, float(np.trace(covariance)))


def merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sum of centred products of two sets of rows together."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    sound = np.flatnonzero(model.sound)
    if not len(sound):
        return None
    k = len(sound)

    def told(total):
        return [[total[0]], [total[1].tobytes()], [total[2].tobytes()]]

    def task(parts):
        total = None
        for (xs,) in parts:
            w = model.whiten(_matrix(xs))[:, sound]
            mean = w.mean(axis=0)
            part = (len(w), mean, (w - mean).T @ (w - mean))
            total = part if total is None else merged(total, part)
        if total:
            yield [[TaskContext.get().partitionId() % MERGE], *told(total)]

    def rows_of(n, mean, products):
        for a, b, c in zip(n, mean, products):
            yield a, np.frombuffer(b), np.frombuffer(c).reshape(k, k)

    def merge(parts):
        total = None
        for columns in parts:
            for part in rows_of(*columns):
                total = part if total is None else merged(total, part)
        if total:
            yield told(total)

    moments = map_batches(fit, ["x"], "slot int, n long, mean binary, products binary", task)
    rest = map_batches(moments.repartition(MERGE, "slot"), ["n", "mean", "products"], "n long, mean binary, products binary", merge)
    total = None
    for part in rows_of(*zip(*[(r["n"], r["mean"], r["products"]) for r in rest.collect()])):
        total = part if total is None else merged(total, part)
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def fit_list(prepared: DataFrame) -> DataFrame:
    """Each distinct ``x`` once, copies combined before the shuffle."""
    return prepared.select("x").distinct()


def usual_length(prepared: DataFrame) -> int | None:
    """The length of most vectors; of several the largest."""
    first = prepared.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return first and first.dims


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of ``(n x - S)^2`` of each row, exact; null where a long can't hold it.

    With ``S = n m + r`` and ``y = x - m`` it is ``n^2 sum(y^2) - 2 n sum(r y) + sum(r^2)``.
    """
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    y = x - whole
    # squares, and products with what is left over, fit a long if the largest of each does so in all dimensions
    if not x.size or int(np.abs(y).max()) ** 2 * len(sums) >= 2**63 or n * int(np.abs(y).max()) * len(sums) >= 2**63:
        y = y.astype(object)
    squares, mixed = (y * y).sum(axis=1), (y * rest).sum(axis=1)
    fixed = sum(int(r) ** 2 for r in rest)
    exact = [n * n * int(a) - 2 * n * int(b) + fixed for a, b in zip(squares, mixed)]
    return [v if v < 2**63 else None for v in exact]


def fit(prepared: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> tuple[Whitening | None, float | None]:
    """Whitening of the distinct ``x`` of ``prepared(x)``, and its identity error; none of an empty table.

    The fit list is written once in the shared folder, read by the passes over it, and deleted.
    """
    spark = prepared.sparkSession
    folder = f"{shared_folder(spark)}/fit-{uuid.uuid4().hex}"
    fit_list(prepared).write.parquet(folder)
    try:
        listed = spark.read.parquet(folder)
        n, sums = column_sums(listed)
        if not n:
            return None, None
        if len(sums) > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {len(sums)} dimensions; {MOST_DIMENSIONS} at most")
        model = decompose(tiled_covariance(listed, n, sums, tile), n, sums, components)
        return model, identity_error(listed, model)
    finally:
        delete(spark, folder)


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of every sound vector and component.

    Vectors that are null or empty or hold null or non-finite entries have no rows, and neither have those of another length
    than most (of several lengths the largest).  Entries beyond 1e15 are taken as that.  Components are numbered from 1 by
    falling eigenvalue; there are no more than dimensions.  Where a component has no variance beyond rounding ``whitened`` is
    null, where none has ``explained`` and ``identity_error`` are.  ``deviation`` is null where a long can't hold it.
    Repeated rows each give rows and count once for the fit; an id may be null; an empty table gives no rows.
    """
    names = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    prepared = integers(vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("v")), "v").select("id", "x")
    dims = usual_length(prepared)
    prepared = prepared.where(F.size("x") == (dims or 0))
    model, error = fit(prepared, components, tile)
    if model is None:
        return prepared.selectExpr("id", "0", "0L", "0L", "0D", "0D", "0D").where("false").toDF(*[f.split()[0] for f in names.split(", ")])
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    k = len(shares)

    def task(parts):
        for keys, xs in parts:
            x = _matrix(xs)
            rows = len(keys)
            away = deviations(x, model.n, model.sums)
            white = model.whiten(x).ravel()
            yield [
                [key for key in keys for _ in range(k)],
                list(range(1, k + 1)) * rows,
                [model.n] * (rows * k),
                [a for a in away for _ in range(k)],
                [None if v != v else v for v in white.tolist()],
                shares * rows,
                [error] * (rows * k),
            ]

    return map_batches(prepared, ["id", "x"], names, task)
