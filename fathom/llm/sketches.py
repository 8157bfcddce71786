"""Operator 13: document fingerprints that keep every shingle hash below a fixed threshold.

Shingles are ``WIDTH`` code points in a row (a shorter text is one shingle), and a fingerprint holds all of their hashes below
one ``FRACTION``-th of the hash range.  So fingerprints of texts of any sizes are samples of the same hashes: their share in
common estimates how much of one text the other one holds, however unequal the two are, and the fingerprint of several texts
together is made from theirs.  A short text has few hashes below the threshold; its fingerprint goes on to the ``FLOOR``
smallest.  Fingerprints are complete up to a bound that shows in them, and two are compared up to the smaller bound.

To find each document's next one, ids are divided into ranges by quantiles.  Every range is sorted by itself, and the first
document of each range also goes to the range before it, as a guest; so there is one shuffle and no order of all rows.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.batches import map_batches, quoted, schema_of

WIDTH = 16
#: One in so many hashes is below the threshold.
FRACTION = 32
LIMIT = np.uint64(2**64 // FRACTION)
#: Hashes that a fingerprint has at least, if the text has as many shingles.
FLOOR = 64
#: Shingles that are hashed at once.
BLOCK = 1 << 18
#: Ranges of ids for each partition of a shuffle.
RANGES = 4

#: Factors of the hashes of 1, 2, 4 and 8 code points, and of the last step.
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every ``WIDTH`` code points in a row; of a shorter text, one of all of them."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    if len(h) < WIDTH:
        total = np.array([len(h)], dtype=np.uint64)
        for c in h:
            total = (total ^ (total >> np.uint64(29))) * _FACTORS[0] + c
        h = total
    else:
        for step, factor in zip((1, 2, 4, 8), _FACTORS):
            h ^= h >> np.uint64(29)
            h = h[:-step] * factor + h[step:]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _trimmed(hashes: np.ndarray) -> np.ndarray:
    """What a fingerprint keeps of different hashes in order."""
    return hashes[: max(int(np.searchsorted(hashes, LIMIT)), FLOOR)]


def fingerprint(text: str) -> np.ndarray:
    """The hashes that are kept of a text's shingles, in order; none of an empty text.  Long texts are hashed in blocks."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.array([], dtype=np.uint64)
    kept = []
    for at in range(0, max(len(codes) - WIDTH + 1, 1), BLOCK):
        h = _hashes(codes[at : at + BLOCK + WIDTH - 1])
        low = np.unique(h[h < LIMIT])
        kept.append(low if len(low) >= FLOOR else np.unique(h)[:FLOOR])
    return _trimmed(kept[0] if len(kept) == 1 else np.unique(np.concatenate(kept)))


def spelled(hashes: np.ndarray) -> str:
    """A fingerprint as text: Base64 of its hashes, eight bytes each with the highest first."""
    return b64encode(hashes.astype(">u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(b64decode(fingerprint), dtype=">u8").astype(np.uint64)


def _bound(hashes: np.ndarray) -> np.uint64:
    """The largest hash up to which a fingerprint has all."""
    if len(hashes) < FLOOR:
        return np.uint64(2**64 - 1)
    return max(LIMIT - np.uint64(1), hashes[-1])


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bound = min(_bound(a), _bound(b))
    return a[: np.searchsorted(a, bound, "right")], b[: np.searchsorted(b, bound, "right")]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of the shingles of two texts together."""
    return _trimmed(np.union1d(*_alike(a, b)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the shingles that two texts share, as a part of those that either has; 1 for two empty texts."""
    x, y = _alike(a, b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else float(np.array_equal(a, b))


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimate of the part of the first text's shingles that the second one has; none if no hash tells."""
    x, y = _alike(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else None


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, fingerprint)`` of every document.

    A null or empty text has no characters and an empty fingerprint.  Repeated rows each give a row; an id may be null; an
    empty table gives no rows.
    """

    def task(parts):
        for keys, texts in parts:
            yield [keys, [len(t or "") for t in texts], [spelled(fingerprint(t or "")) for t in texts]]

    return map_batches(docs, [id_col, text_col], f"{id_col} long, n_chars long, fingerprint string", task)


def _ranges(docs: DataFrame, ranges: int) -> tuple[np.ndarray, dict[int, int | None]]:
    """The ids from which new ranges of ``docs(id)`` begin, and the smallest id of each range that has any; null is smaller
    than all others."""
    shares = [n / ranges for n in range(1, ranges)]
    cuts = docs.where("id is not null").approxQuantile("id", shares, 1 / (4 * ranges)) if shares else []
    cuts = np.unique(np.array(cuts, dtype=np.float64).astype(np.int64))

    def task(parts):
        least: dict[int, int | None] = {}
        for (keys,) in parts:
            if None in keys:
                least[0] = None
            found = np.array([k for k in keys if k is not None], dtype=np.int64)
            for part, key in zip(np.searchsorted(cuts, found, "right").tolist(), found.tolist()):
                if part not in least or least[part] is not None and key < least[part]:
                    least[part] = key
        yield [list(least), list(least.values())]

    told = map_batches(docs, ["id"], "part int, least long", task, rows=1 << 16)
    rows = told.groupBy("part").agg(F.bool_or(F.col("least").isNull()).alias("null"), F.min("least").alias("least")).collect()
    return cuts, {r.part: None if r["null"] else r.least for r in rows}


def with_neighbours(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, guest, id, text)`` of every document, partitioned by ``part`` and sorted within.

    A part's own documents (``guest`` is 0) come in order of id, null first, and of the XXH64 of the text; the first guest
    behind them is the next document.  The guest of the last part is the first document of all.
    """
    named = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    ranges = ranges or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, least = _ranges(named.select("id"), ranges)
    filled = sorted(least)
    # the part before each one, and the id with which it begins
    before = np.full(len(cuts) + 1, -1, dtype=np.int32)
    first = np.zeros(len(cuts) + 1, dtype=np.int64)
    for n, part in enumerate(filled):
        before[part], first[part] = filled[n - 1], least[part] or 0
    null_first = bool(filled) and least[filled[0]] is None

    @F.arrow_udf(schema_of("part int, host int"))
    def places(ids: pa.Array) -> pa.Array:
        absent = np.asarray(ids.is_null())
        values = np.asarray(ids.fill_null(0))
        part = np.where(absent, 0, np.searchsorted(cuts, values, "right"))
        begins = np.where(part == 0, absent if null_first else ~absent & (values == first[0]), values == first[part])
        return pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(np.where(begins, before[part], -1), pa.int32())], ["part", "host"])

    placed = named.withColumn("at", places("id"))
    own, guest = F.struct(F.col("at.part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("at.host").alias("part"), F.lit(1).alias("guest"))
    dealt = placed.select("id", "text", F.explode(F.when(F.col("at.host") >= 0, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.part", "to.guest", "id", "text").repartition("part")
    return dealt.sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), F.xxhash64("text"))


def compare_edited(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The edited text has its last ``n_chars // 2`` code points replaced by as many of the next document's first ones, or all.
    The next document is the one with the next larger id, after the last the first; rows with the same id follow each other by
    the XXH64 of their texts, null ids come first, and a single document is its own next one.  Columns: ``id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and ``contained_edited, contained_next``, the part
    of this document's shingles that the edited text and the next document hold (null if no hash tells).  A null text counts
    as empty.  Repeated rows each give a row; an empty table gives no rows.
    """

    def row(key, text, hashes, after, after_hashes):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = fingerprint(edited)
        return (
            *(key, len(text), sha256(edited.encode()).hexdigest(), spelled(hashes), spelled(changed)),
            *(likeness(hashes, changed), likeness(hashes, after_hashes), containment(hashes, changed), containment(hashes, after_hashes)),
        )

    def task(parts):
        waiting = None
        for columns in parts:
            out = []
            for guest, key, text in zip(*columns):
                if guest and waiting is None:
                    continue  # the guests behind the first one
                hashes = fingerprint(text)
                if waiting is not None:
                    out.append(row(*waiting, text, hashes))
                waiting = None if guest else (key, text, hashes)
            if out:
                yield [list(c) for c in zip(*out)]

    ddl = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"
    return map_batches(with_neighbours(docs, ranges, id_col, text_col), ["guest", "id", "text"], ddl, task)
