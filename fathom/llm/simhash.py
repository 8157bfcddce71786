"""Operator 3: near-duplicates by SimHash, found by a self-join of binary tries.

Fingerprints that differ in at most ``DIFFER`` of 64 bits and are cut into ``k`` blocks agree in at least ``k - DIFFER`` of
them.  For every choice of that many blocks there is one trie, over the fingerprints with these bits moved to
the front: the subtries below those bits are the groups that the cluster deals out, and each is joined with
itself.  The join goes down two nodes of the trie at a time, adds up the bits in which their paths differ and
drops the pair as soon as these are over the budget.  The result is the same for every ``k``; it only balances the
number of tries against the size of groups, and grows with the number of different fingerprints.

A group with many fingerprints is divided into parts, and each pair of parts is joined by a task of its own, so
no group is too large for a task and no link is left out.  A task returns its links as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fathom.llm.batches import map_batches
from fathom.llm.graph import component_least, cut_lineage, deal_groups, spanning_forest

DIFFER = 4
SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints of a group that one task joins with themselves or with as many others.
GROUP_ROWS = 4096
#: Mean size of a group from which more blocks are used.
MEAN_ROWS = 512
#: Node pairs that are expanded at once.
FRONTIER = 1 << 18
#: Rows of complete groups that are joined together in a task.
TRIE_ROWS = 1 << 16
#: Hashes whose bits are counted at once.
HASHES = 1 << 14


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """Hashes of a text's word shingles, in order of place; of all its words if they are fewer."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, and only \x20 and \x09-\x0D divide
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), (ends[words - 1 :] - 1).tolist())]


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles; 0 if it has no word."""
    return fingerprint_of(np.array(shingle_hashes(text, words), dtype=np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; a few thousand of these at a time."""
    over = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].astype("<u8", copy=False)
        over += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` of every document; a null text counts as empty."""

    def task(parts):
        for keys, texts in parts:
            values = np.array([fingerprint(t or "", words) for t in texts], dtype=np.uint64)
            yield [keys, values.view(np.int64)]

    return map_batches(docs, [id_col, text_col], "id long, fp long", task)


def blocks_of(k: int) -> list[tuple[int, int]]:
    """(first bit from the top, number of bits) of ``k`` blocks of 64 bits."""
    edges = [64 * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def plan_tries(n: int, differ: int = DIFFER) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Blocks in front and behind of each trie, for ``n`` different fingerprints."""
    k = differ + 1
    while n >> (64 * (k - differ) // k) > MEAN_ROWS and k < 2 * differ:
        k += 1
    blocks = blocks_of(k)
    return [([blocks[i] for i in front], [b for i, b in enumerate(blocks) if i not in front]) for front in combinations(range(k), k - differ)]


def rotate(values: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The bits of the blocks, one after the other."""
    out = np.zeros_like(values)
    for at, n in blocks:
        out = (out << np.uint64(n)) | ((values >> np.uint64(64 - at - n)) & np.uint64((1 << n) - 1))
    return out


def join_tries(values: np.ndarray, depth: int, pairs: np.ndarray, differ: int = DIFFER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values that differ in at most ``differ`` bits.

    ``pairs`` has the rows (a from, a to, b from, b to) of index ranges; a range holds one subtrie of that depth
    in order, and the two of a pair have the same path above it.  A range paired with itself is joined with itself.
    """
    ones: dict[int, np.ndarray] = {}

    def counts(d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        return ones[d]

    stack = [(depth, pairs.astype(np.int64), np.zeros(len(pairs), dtype=np.int64))]
    while stack:
        d, p, far = stack.pop()
        if len(p) > FRONTIER:
            half = len(p) // 2
            stack += [(d, p[:half], far[:half]), (d, p[half:], far[half:])]
            continue
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        few = na * nb <= 16
        if few.any():
            yield from _compare(values, p[few], differ)
            p, far = p[~few], far[~few]
        if not len(p):
            continue
        c = counts(d)
        am, bm = p[:, 1] - (c[p[:, 1]] - c[p[:, 0]]), p[:, 3] - (c[p[:, 3]] - c[p[:, 2]])
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        children = [
            (np.stack([p[:, 0], am, p[:, 2], bm], 1), far),
            (np.stack([am, p[:, 1], bm, p[:, 3]], 1), far),
            (np.stack([p[:, 0], am, bm, p[:, 3]], 1), far + 1),
            (np.stack([am, p[:, 1], p[:, 2], bm], 1)[~same], far[~same] + 1),
        ]
        p, far = np.concatenate([x for x, _ in children]), np.concatenate([x for _, x in children])
        keep = (far <= differ) & (p[:, 0] < p[:, 1]) & (p[:, 2] < p[:, 3])
        if keep.any():
            stack.append((d + 1, p[keep], far[keep]))


def _compare(values: np.ndarray, p: np.ndarray, differ: int):
    """Leaves: all pairs below small nodes, bit by bit."""
    na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
    n = na * nb
    row = np.repeat(np.arange(len(p)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    i, j = p[row, 0] + k // nb[row], p[row, 2] + k % nb[row]
    near = np.bitwise_count(values[i] ^ values[j]) <= differ
    near &= ~((p[row, 0] == p[row, 2]) & (i >= j))
    if near.any():
        yield i[near], j[near]


def near_links(nodes: DataFrame, differ: int = DIFFER, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(u, v)`` links between the different fingerprints ``nodes(fp)`` that connect all within ``differ`` bits."""
    tries = plan_tries(nodes.count(), differ)
    depth = sum(n for _, n in tries[0][0])

    def key(front):
        out = F.lit(0).cast("long")
        for at, n in front:
            out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned("fp", 64 - at - n).bitwiseAND(F.lit((1 << n) - 1).cast("long")))
        return out

    placed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), key(front).alias("path")) for t, (front, _) in enumerate(tries)])).alias("at")).select("fp", "at.*")
    dealt = deal_groups(placed, ["trie", "path"], "fp", group_rows).select("trie", "path", "a", "b", "side", "fp")
    dealt = dealt.repartition("trie", "path", "a", "b").sortWithinPartitions("trie", "path", "a", "b")

    def task(parts):
        held: list[np.ndarray] = []
        rows = 0

        def flush(data: np.ndarray):
            fps = data[:, 5].view(np.uint64)
            turned = np.empty_like(fps)
            for t in np.unique(data[:, 0]).tolist():
                mine = data[:, 0] == t
                front, behind = tries[t]
                turned[mine] = rotate(fps[mine], front + behind)
            new = np.concatenate([[True], (data[1:, :4] != data[:-1, :4]).any(axis=1)])
            group = np.cumsum(new) - 1
            order = np.lexsort((turned, data[:, 4], group))
            turned, fps, side, group = turned[order], fps[order], data[order, 4], group[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            stops = np.append(starts[1:], len(group))
            crossed = data[order][starts, 2] != data[order][starts, 3]
            middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
            pairs = np.stack([starts, np.where(crossed, middle, stops), np.where(crossed, middle, starts), stops], 1)
            pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
            label = spanning_forest(len(fps), join_tries(turned, depth, pairs, differ))
            linked = np.flatnonzero(label != np.arange(len(fps)))
            return [fps[linked].view(np.int64), fps[label[linked]].view(np.int64)]

        for columns in parts:
            data = np.array(columns, dtype=np.int64).T
            held.append(data)
            rows += len(data)
            if rows >= TRIE_ROWS:
                data = np.concatenate(held)
                inner = np.flatnonzero((data[1:, :4] != data[:-1, :4]).any(axis=1))
                if len(inner):  # the last group may go on in the next slice
                    stop = int(inner[-1]) + 1
                    yield flush(data[:stop])
                    data = data[stop:]
                held, rows = [data], len(data)
        if rows:
            yield flush(np.concatenate(held))

    return map_batches(dealt, ["trie", "path", "a", "b", "side", "fp"], "u long, v long", task, rows=8192)


def near_duplicates(docs: DataFrame, differ: int = DIFFER, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of every document.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id that links reach, the document's
    own included.  A null or empty text, or one of white space only, has fingerprint zero and is linked like any other.
    Repeated rows each give a row; rows with a null id count, and a component of these alone has a null id.  An empty
    table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, words, id_col, text_col))
    least = F.min("id")
    nodes = cut_lineage(prints.groupBy(F.col("fp").alias("node")).agg(F.struct(least.isNull().alias("absent"), least.alias("id")).alias("order")))
    classes = component_least(nodes, near_links(nodes.select(F.col("node").alias("fp")), differ)).select(F.col("node").alias("fp"), F.col("least.id").alias("component_id"))
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
