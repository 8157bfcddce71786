"""Operator 3 where near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A pair at that similarity differs in ten bits of a SimHash on average and in 24 now and then, for which matching blocks of
64 bits are no help: nearly all fingerprints would share one.  So the tries stand below keys of another kind, ``BANDS`` of
``BAND_ROWS`` minima of the shingles' hashes each: texts that agree in a key are a group, and the tries of a group's
fingerprints are joined with a budget of ``DIFFER`` bits.  A pair at a similarity of exactly 0.8 meets in none of the groups
with a probability of 0.0007 and is over the budget with less, a closer one with less than that.  Every pair that the tries
leave is verified on the whole shingle sets.

All links come from self-joins of these tries.  In the first one a large group is divided into parts, with its smallest
member in each, and of the pairs that a part's trie leaves each text keeps the one with its smallest partner; so a group of
near copies costs one verification a text.  Groups that this leaves in several components are joined once more, a large one
divided into pairs of parts, and pairs that links connect already aren't verified; so no group is too large for a task and no
pair that meets in a group is left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fathom.llm.batches import map_batches, quoted
from fathom.llm.graph import DisjointSets, component_least, connected_components, cut_lineage, deal_groups
from fathom.llm.simhash import SEED, TRIE_ROWS, fingerprint_of, join_tries, shingle_hashes

SHINGLE_WORDS = 5
#: Least Jaccard similarity of a link, as a fraction.
LEAST, OF = 4, 5
BANDS, BAND_ROWS = 24, 6
#: Bits in which the fingerprints of a link's sets may differ.  A bit differs with a probability of at most 0.19.
DIFFER = 26
#: Texts of a group that one task compares with themselves or with as many others.
GROUP_ROWS = 256
#: Texts that one task verifies as partners of one text.
STAR_ROWS = 4096
#: Rows of a few numbers each, up to which a table is sent to every task that joins it with texts or sets, which then stay
#: where they are; a larger one is joined by a shuffle.
SENT_ROWS = 1 << 20
#: Shingles whose minima are computed at once.
BLOCK = 4096

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 2**63, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64)
_FACTOR = _RANDOM.integers(0, 2**63, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of a text's different shingles, in order; none if it has no word."""
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; a set without members has keys of its own."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK):
        turned = (hashes[None, at : at + BLOCK] ^ _FLIP) * _FACTOR
        np.minimum(least, turned.min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, in order, reach the similarity."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return OF * both >= LEAST * (len(x) + len(y) - both)


def sent(numbers: DataFrame, rows: int) -> DataFrame:
    """A table of numbers, to be sent to every task if it has so few rows."""
    return F.broadcast(numbers) if rows <= SENT_ROWS else numbers


def least_partners(groups: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> list[np.ndarray]:
    """``[u, v]``: of each node ``v`` its smallest partner ``u`` in its group, if that is smaller than itself.

    Partners are the pairs that the self-join of a group's trie leaves; all groups are joined at once.
    """
    order = np.lexsort((prints.view(np.uint64), groups))
    groups, nodes, values = groups[order], nodes[order], prints.view(np.uint64)[order]
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    stops = np.append(starts[1:], len(groups))
    least = nodes.copy()
    for i, j in join_tries(values, 0, np.stack([starts, stops, starts, stops], 1)[stops - starts > 1], DIFFER):
        np.minimum.at(least, np.where(nodes[i] > nodes[j], i, j), np.minimum(nodes[i], nodes[j]))
    found = np.flatnonzero(least != nodes)
    return [least[found], nodes[found]]


def _first_pairs(members: DataFrame, group_rows: int) -> DataFrame:
    """The different pairs of :func:`least_partners` in the groups of ``members(path, node, fp, n, first)``.

    ``n`` is the number of a group's members and ``first`` the smallest of them, which is in each part of a large group.
    """
    parts = F.ceil(F.col("n") / group_rows).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = members.select("path", F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(own)).alias("part"), "node", "fp")
    dealt = dealt.repartition("path", "part").sortWithinPartitions("path", "part")

    def joined(data):
        new = np.concatenate([[True], (data[1:, :2] != data[:-1, :2]).any(axis=1)])
        return least_partners(np.cumsum(new), data[:, 2], data[:, 3].copy())

    def task(slices):
        held = np.empty((0, 4), dtype=np.int64)
        for columns in slices:
            held = np.concatenate([held, np.array(columns, dtype=np.int64).T])
            if len(held) >= TRIE_ROWS:  # the last group may go on in the next slice
                inner = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1))
                stop = int(inner[-1]) + 1 if len(inner) else 0
                if stop:
                    yield joined(held[:stop])
                    held = held[stop:]
        if len(held):
            yield joined(held)

    return map_batches(dealt, ["path", "part", "node", "fp"], "u long, v long", task, rows=8192).distinct()


def _star_links(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The links ``(u, v)`` among ``edges(u, v)`` whose sets are similar.

    The set of ``u`` goes once to each task that compares it, and a task compares it with a bounded number of others.
    """
    n = edges.count()
    sizes = edges.groupBy("u").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    dealt = edges.join(sizes.where("parts > 1"), "u", "left").select("u", "v", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("part"))
    hubs = sizes.select(F.col("u").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hubs = sets.join(sent(hubs, n), "node")
    others = sets.withColumnRenamed("node", "v").join(sent(dealt, n), "v").select("u", "part", "v", "hashes")
    rows = hubs.select(F.col("node").alias("u"), "part", F.lit(None).cast("long").alias("v"), "hashes").unionByName(others)
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())

    def task(parts):
        hub = np.array([], dtype=np.uint64)
        for columns in parts:
            out = []
            for u, v, hashes in zip(*columns):
                members = np.frombuffer(hashes, dtype=np.uint64)
                if v is None:
                    hub = members
                elif similar(hub, members):
                    out.append((u, v))
            if out:
                yield [list(c) for c in zip(*out)]

    return map_batches(rows, ["u", "v", "hashes"], "u long, v long", task)


def cell_links(nodes: list[int], roots: list[int], sides: list[int], crossed: bool, prints: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is similar among the members of a cell, beyond what the roots connect already."""
    known = DisjointSets(len(nodes))
    first: dict[int, int] = {}
    for i, root in enumerate(roots):
        known.join(first.setdefault(root, i), i)
    values = np.array(prints, dtype=np.int64).view(np.uint64)
    order = np.lexsort((values, sides if crossed else np.zeros(len(nodes))))
    middle = sides.count(0) if crossed else 0
    ranges = np.array([[0, middle or len(nodes), middle, len(nodes)]])
    out = []
    for a, b in join_tries(values[order], 0, ranges, DIFFER):
        for i, j in zip(order[a].tolist(), order[b].tolist()):
            if known.find(i) != known.find(j) and similar(sets[i], sets[j]):
                known.join(i, j)
                out.append((nodes[i], nodes[j]))
    return out


def _rest_links(members: DataFrame, sets: DataFrame, group_rows: int) -> DataFrame:
    """Links between the different components of each group of ``members(path, node, fp, root)``."""
    dealt = deal_groups(members, ["path"], "node", group_rows).join(sets, "node")
    dealt = dealt.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b")

    def task(parts):
        cell, rows = None, []
        for columns in parts:
            for path, a, b, *row in zip(*columns):
                if (path, a, b) != cell:
                    yield from flush(cell, rows)
                    cell, rows = (path, a, b), []
                rows.append(row)
        yield from flush(cell, rows)

    def flush(cell, rows):
        if len(rows) > 1:
            sides, nodes, roots, prints, sets = map(list, zip(*rows))
            if links := cell_links(nodes, roots, sides, cell[1] != cell[2], prints, [np.frombuffer(s, dtype=np.uint64) for s in sets]):
                yield [list(c) for c in zip(*links)]

    return map_batches(dealt, ["path", "a", "b", "side", "node", "root", "fp", "hashes"], "u long, v long", task)


def keep_representatives(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row of each group of near copies, in its own columns: that with the smallest id, and of several the first.

    Groups are what links join.  Texts with the same shingles are one node; null, empty and blank ones are copies of each
    other.  Rows with the same id are documents of their own.  A row with a null id stays only where its group has no other.
    The rows are written once with their number, so no number is computed twice; the name of that column is one that the
    table doesn't have.  An empty table gives no rows.
    """
    number = "row"
    while number in (c.lower() for c in docs.columns):
        number += "_"
    placed = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))

    def prints(parts):
        for rows, texts in parts:
            sets = [shingle_set(t or "", words) for t in texts]
            digests = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([fingerprint_of(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield [rows, digests, fps, [len(s) for s in sets], [band_keys(s) for s in sets]]

    printed = cut_lineage(map_batches(placed, [number, quoted(text_col)], "row long, node long, fp long, size long, paths array<long>", prints))
    order = placed.select(F.col(number).alias("row"), F.struct(F.col(quoted(id_col)).isNull().alias("absent"), F.col(quoted(id_col)).alias("key"), F.col(number).alias("row")).alias("order"))
    nodes = cut_lineage(printed.select("row", "node").join(order, "row").groupBy("node").agg(F.min("order").alias("order")))
    # each node is placed once, by the row that stands for it, and only where it isn't alone
    shown = printed.join(nodes.select(F.col("order.row").alias("row")), "row", "left_semi").where("size > 0")
    grouped = shown.select("node", "fp", F.explode("paths").alias("path"))
    shared = grouped.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    members = cut_lineage(grouped.join(shared, "path"))
    facts = cut_lineage(shown.select("node", "fp", "row", "size").join(members.select("node").distinct(), "node", "left_semi"))

    texts = placed.select(F.col(number).alias("row"), F.col(quoted(text_col)).alias("text")).join(sent(facts.select("row", "node"), facts.count()), "row")

    def hashes(parts):
        for keys, values in parts:
            yield [keys, [shingle_set(t, words).tobytes() for t in values]]

    sets = cut_lineage(map_batches(texts, ["node", "text"], "node long, hashes binary", hashes))
    edges = _first_pairs(members, group_rows)
    for end in ("u", "v"):
        edges = edges.join(facts.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size")), end)
    edges = cut_lineage(edges.where(f"{OF} * least(u_size, v_size) >= {LEAST} * greatest(u_size, v_size)").select("u", "v"))
    stars = cut_lineage(_star_links(edges, sets))
    roots = connected_components(stars)
    rooted = members.select("path", "node").join(roots, "node", "left").select("path", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("path").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("path")
    rest = _rest_links(cut_lineage(rooted.join(mixed, "path", "left_semi").join(facts.select("node", "fp"), "node")), sets, group_rows)
    kept = component_least(nodes, stars.unionByName(cut_lineage(rest))).where("node = root").select(F.col("order.row").alias(number))
    kept = cut_lineage(kept)
    n, whole = kept.count(), printed.count()
    if n <= whole - n:
        found = placed.join(sent(kept, n), number, "left_semi")
    else:  # fewer rows go than stay
        gone = printed.select(F.col("row").alias(number)).join(kept, number, "left_anti")
        found = placed.join(sent(gone, whole - n), number, "left_anti")
    return found.select(*[quoted(c) for c in docs.columns])
