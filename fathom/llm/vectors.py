"""Operator 8: near-duplicate vectors by hashing to E8 lattice points.

Unit vectors are projected at random to a few groups of eight coordinates and each group is decoded to the nearest
point of the E8 lattice; the points of all groups together are the vector's home cell.  A vector also looks into the
cells next to its own that are nearest to its projection.  Several tables with projections of their own make up for
pairs that are far apart in one.  Pairs that meet are verified by their cosine in double precision.

Copies are one vector with a count.  Cells are found with numbers only; vectors are sent, in the type that they come in,
to the cells where another one is.  A pair can meet several times; it counts only where it meets first, which both
sides' cells in all tables tell, so links are counted without being listed.  A cell with many vectors is divided into
pairs of parts, each a task's work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fathom.llm.batches import schema_of
from fathom.llm.graph import component_least, cut_lineage, deal_parts, spanning_forest

COSINE = 0.93
#: Tables, groups of eight coordinates in each, cells looked into besides the home cell, and the projection's scale.
TABLES, GROUPS, PROBES, SCALE, SEED = 6, 2, 4, 0.42, 5
#: Rows of a cell that one task compares with each other or with as many others.
CELL_ROWS = 1024
#: Pairs that are compared at once, and rows of complete cells that are taken together.
PAIRS, ROWS = 1 << 17, 1 << 13


def shortest_vectors() -> np.ndarray:
    """The 240 neighbours of the origin in E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


NEIGHBOURS = shortest_vectors()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(x)
    off = x - point
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    point[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of the even integer points or of these moved by a half."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _rows_times(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """x @ matrix, with sums that don't depend on the other rows; so a vector's cells are the same in every task."""
    out = np.zeros((len(x), matrix.shape[1]))
    for k in range(matrix.shape[0]):
        out += x[:, k : k + 1] * matrix[k]
    return out


@lru_cache(maxsize=16)
def projection(size: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shift, and multipliers that turn lattice points into cell numbers."""
    rng = np.random.default_rng([SEED, size, table])
    directions = rng.normal(size=(size, 8 * GROUPS))
    directions = np.linalg.qr(directions)[0] if size >= 8 * GROUPS else directions / np.sqrt(size)
    return directions * np.sqrt(size) * SCALE, rng.uniform(0, 1, 8 * GROUPS), rng.integers(1, 1 << 62, 8 * GROUPS) * 2 + 1


def cells(unit: np.ndarray, table: int) -> np.ndarray:
    """Cell numbers (rows, 1 + PROBES) of unit vectors in a table: the home cell, then its nearest neighbours."""
    directions, shift, mix = projection(unit.shape[1], table)
    y = _rows_times(unit, directions) + shift
    points = np.concatenate([nearest_e8(y[:, 8 * g : 8 * g + 8]) for g in range(GROUPS)], axis=1)
    closer = np.concatenate([_rows_times((y - points)[:, 8 * g : 8 * g + 8], NEIGHBOURS.T) for g in range(GROUPS)], axis=1)
    moves = np.argpartition(-closer, PROBES, axis=1)[:, :PROBES]
    steps = np.zeros((GROUPS * 240, 8 * GROUPS), dtype=np.int64)
    for g in range(GROUPS):
        steps[240 * g : 240 * (g + 1), 8 * g : 8 * g + 8] = (2 * NEIGHBOURS).astype(np.int64)
    with np.errstate(over="ignore"):
        home = ((2 * points).astype(np.int64) * mix).sum(axis=1)
        return np.concatenate([home[:, None], home[:, None] + (steps * mix).sum(axis=1)[moves]], axis=1)


def all_cells(unit: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + PROBES)"""
    return np.stack([cells(unit, t) for t in range(TABLES)], axis=1)


#: Between these, the square of a vector's largest component and sums of such are well within doubles.
SQUARED = 1e-120, 1e120


def _matrix(column: pa.Array, size: int, double: bool) -> np.ndarray:
    """Vectors of the same size from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64 if double else np.float32).astype(np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def marked(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, double, vector, copy)``: ``copy`` is a 128-bit digest of label and vector, null if it can't have links.

    ``vector`` has the numbers as bytes, 32 bits each where the column has such, otherwise 64.
    """
    schema = schema_of("id long, label long, double boolean, vector binary, copy binary")
    double = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"

    def run(batches):
        for batch in batches:
            ids, labels, lists = batch.columns
            digests, kept = [], []
            for label, v in zip(labels.to_pylist(), lists.to_pylist()):
                ok = label is not None and bool(v) and None not in v
                x = np.array(v, dtype=np.float64) if ok else None
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                if ok and not SQUARED[0] < (largest := np.abs(x).max()) < SQUARED[1]:
                    x = x / largest  # squares would vanish in doubles or go beyond them; cosines don't change
                kept.append((x if double else x.astype(np.float32)).tobytes() if ok else None)
                digests.append(blake2b(x.tobytes(), digest_size=16, key=str(label).encode()).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), labels.cast(pa.int64()), pa.array([double] * len(kept)), pa.array(kept, type=pa.binary()), pa.array(digests, type=pa.binary())], schema=to_arrow_schema(schema))

    cast = "array<double>" if double else "array<float>"
    return vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vector_col).cast(cast)).mapInArrow(run, schema)


def celled(distinct: DataFrame) -> DataFrame:
    """``distinct`` with its ``size`` and ``cells``: in each table the home cell and those that the vector looks into.

    A cell is a hash of label, size, table and lattice point.
    """
    schema = schema_of("node long, label long, double boolean, vector binary, copy binary, n long, least long, size int, cells array<long>")

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                double = part["double"][0].as_py()
                sizes = np.array([len(v) for v in part["vector"].to_pylist()]) // (8 if double else 4)
                for size in np.unique(sizes).tolist():
                    mine = part.take(pa.array(np.flatnonzero(sizes == size)))
                    table = np.arange(TABLES, dtype=np.uint64)[None, :, None]
                    with np.errstate(over="ignore"):
                        key = all_cells(_unit(_matrix(mine["vector"], size, double))).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= (mine["label"].to_numpy().view(np.uint64)[:, None, None] * np.uint64(TABLES) + table) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(size)
                        key = (key ^ key >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
                    cells = pa.array(list(key.view(np.int64).reshape(mine.num_rows, -1)), type=pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(np.full(mine.num_rows, size, dtype=np.int32)), cells], schema=arrow)

    return distinct.select("node", "label", "double", "vector", "copy", "n", "least").mapInArrow(run, schema)


def _candidates(starts: np.ndarray, stops: np.ndarray, homes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row, home row) within cells whose home rows come first, in blocks."""
    work = (stops - starts) * homes
    at = 0
    while at < len(starts):
        to = at + max(1, int(np.searchsorted(np.cumsum(work[at:]), PAIRS, side="right")))
        for lo in range(0, int(stops[at] - starts[at]) if to == at + 1 else 1, max(1, PAIRS // max(1, int(homes[at])))):
            if to == at + 1:  # one cell, perhaps a large one: some of its rows at a time
                rows = np.arange(starts[at] + lo, min(stops[at], starts[at] + lo + max(1, PAIRS // max(1, int(homes[at])))))
                yield np.repeat(rows, homes[at]), np.tile(np.arange(starts[at], starts[at] + homes[at]), len(rows))
            else:
                n = work[at:to]
                cell = np.repeat(np.arange(at, to), n)
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield starts[cell] + k // homes[cell], starts[cell] + k % homes[cell]
        at = to


def _links(table: pa.Table, threshold: float):
    """Links and forest of complete cells of one size and table: ``node, parent, links`` of each vector with any."""
    size, t, double = (table[c][0].as_py() for c in ("size", "trie", "double"))
    column = {c: table[c].to_numpy() for c in ("label", "cell", "a", "b", "side", "n", "home", "node")}
    keys = np.stack([column[c].astype(np.int64) for c in ("cell", "a", "b")], 1)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    group = np.cumsum(new) - 1
    order = np.lexsort((~column["home"].astype(bool), group))
    unit = _unit(_matrix(table["vector"], size, double))[order]
    home, side, n, group, kind = column["home"].astype(bool)[order], column["side"][order], column["n"][order], group[order], column["label"][order]
    crossed = (column["a"] != column["b"])[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    stops = np.append(starts[1:], len(group))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    some = (homes > 0) & (stops - starts > 1)
    # one number for each vector, whatever number of rows it has here
    distinct, number = np.unique(column["node"][order], return_inverse=True)
    degree = np.zeros(len(distinct), dtype=np.int64)
    at_row = np.zeros(len(distinct), dtype=np.int64)
    at_row[number] = np.arange(len(number))
    known: dict[int, np.ndarray] = {}

    def seen(numbers: np.ndarray) -> np.ndarray:
        fresh = [x for x in np.unique(numbers).tolist() if x not in known]
        if fresh:
            for x, c in zip(fresh, all_cells(unit[at_row[fresh]])):
                known[x] = c
        return np.stack([known[x] for x in numbers.tolist()])

    def found():
        for i, j in _candidates(starts[some], stops[some], homes[some]):
            ok = (number[i] != number[j]) & ~(home[i] & (number[i] > number[j])) & ~(crossed[i] & (side[i] == side[j])) & (kind[i] == kind[j])
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            i, j = i[near], j[near]
            if not len(i):
                continue
            yield number[i], number[j]
            for lo in range(0, len(i), 1 << 14):
                x, y = number[i[lo : lo + (1 << 14)]], number[j[lo : lo + (1 << 14)]]
                cx, cy = seen(x), seen(y)
                to_y = (cx == cy[:, :, :1]).any(axis=2)  # x looks into y's home cell
                to_x = (cy == cx[:, :, :1]).any(axis=2)
                first = ~(to_y | to_x)[:, :t].any(axis=1)
                # the other cell of the same table: its home row is x, and the smaller number looks
                twice = to_x[:, t] & to_y[:, t] & ~home[i[lo : lo + (1 << 14)]] & (x > y)
                x, y = x[first & ~twice], y[first & ~twice]
                np.add.at(degree, x, n[at_row[y]])
                np.add.at(degree, y, n[at_row[x]])

    label = spanning_forest(len(distinct), found())
    told = np.flatnonzero((degree > 0) | (label != np.arange(len(distinct))))
    return [distinct[told], distinct[label[told]], degree[told]]


def near_vectors(vectors: DataFrame, threshold: float = COSINE, cell_rows: int = CELL_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every vector.

    Vectors are linked if their labels are equal and not null, they have as many components, and their cosine is at
    least ``threshold``.  One that is null, empty or zero, or holds a null, a NaN or an infinity, has no links.
    ``component_id`` is the smallest id that links reach, the vector's own included; ``kept`` says that it is its own.
    Repeated rows are vectors of their own and linked like other copies; a row with a null id can be linked but isn't
    kept.  An empty table gives no rows.
    """
    rows = marked(vectors, id_col, vector_col, label_col)
    distinct = rows.where("copy is not null").groupBy("copy").agg(*[F.first(c).alias(c) for c in ("label", "double", "vector")], F.count("*").alias("n"), F.min("id").alias("least"))
    distinct = cut_lineage(celled(cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))))
    placed = distinct.select("node", F.posexplode("cells").alias("at", "cell")).select("node", "cell", (F.col("at") % (1 + PROBES) == 0).alias("home"), F.floor(F.col("at") / (1 + PROBES)).cast("int").alias("trie"))
    # only where somebody is at home and somebody else is there too
    meeting = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("home").alias("some")).where("rows > 1 and some").select("cell", "rows")
    dealt = deal_parts(placed.join(meeting, "cell"), "node", F.col("rows"), cell_rows).select("node", "cell", "home", "trie", "a", "b", "side")
    dealt = dealt.join(distinct.select("node", "label", "double", "vector", "n", "size"), "node")
    keys = ["size", "trie", "cell", "a", "b"]
    dealt = dealt.repartition("cell", "a", "b").sortWithinPartitions(*keys)
    schema = schema_of("node long, parent long, links long")

    def run(batches):
        arrow = to_arrow_schema(schema)

        def told(table):
            # complete cells of each size and table in turn
            bounds = np.stack([table["size"].to_numpy(), table["trie"].to_numpy()], 1)
            edges = [0, *(np.flatnonzero((bounds[1:] != bounds[:-1]).any(axis=1)) + 1).tolist(), len(bounds)]
            for a, b in zip(edges, edges[1:]):
                out = _links(table.slice(a, b - a).combine_chunks(), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            table = pa.Table.from_batches(held)
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in keys], 1)
            inner = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            if len(inner):  # the last cell may go on in the next batch
                stop = int(inner[-1]) + 1
                yield from told(table.slice(0, stop))
                table = table.slice(stop)
            held, n = table.to_batches(), table.num_rows
        if n:
            yield from told(pa.Table.from_batches(held))

    links = cut_lineage(dealt.mapInArrow(run, schema))
    nodes = distinct.select("node", F.struct(F.col("least").isNull().alias("absent"), F.col("least").alias("id")).alias("order"))
    least = component_least(nodes, links.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = distinct.select("node", "copy", "n").join(least, "node").join(degrees, "node", "left")
    classes = classes.select("copy", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least.id").alias("component_id"))
    out = rows.select("id", "copy").join(classes, "copy", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
