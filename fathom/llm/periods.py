"""Operator 11: periodic runs of words, by blocks that recur.

Words become numbers.  At each scale the document is divided into aligned blocks of a power of two of words, and an
Aho-Corasick automaton over sequences of numbers finds where else each block stands.  A block that stands again at a
distance that the scale is for is a seed: the two copies are compared word by word to both sides as far as they agree, and
what has agreed is a run if it is long enough.

Why none is missed: a run with period ``q`` and three periods or more holds an aligned block of the scale of ``q`` whose copy
``q`` words on is within the run as well.  Why the time stays near ``n log n`` for texts that repeat at all scales: blocks
deep inside a run of a smaller scale can only find that run again and are left out; and where a block is periodic itself, its
occurrences form a few stretches, of which a run of a larger period must match the starts or the ends.  A block is searched
for only if every eight words in it recur at such a distance, as hashes tell; equal hashes of different words cost a search,
never a result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.batches import map_batches, quoted

#: Words of the shortest run, and how often its period fits in at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the smallest blocks; they are for all periods below twice as many.
SMALLEST = 8
#: Factors of the hashes of 1, 2 and 4 words, and of a word's number.
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Words that are compared first when a seed is extended; twice as many each time that all agree.
FIRST_STEP = 32


def numbers_of(words: list) -> np.ndarray:
    """Each word's number; equal words have equal ones."""
    known = {w: n for n, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def recurrence(ids: np.ndarray) -> np.ndarray:
    """For each start of ``SMALLEST`` words, how far on the same hash of as many words is next; a huge number if nowhere."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(32)
    for step, factor in zip((1, 2, 4), _FACTORS):
        h = h[:-step] * factor + h[step:]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    far = np.full(len(h), np.iinfo(np.int64).max)
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def extent(ids: np.ndarray, start: int, stop: int, distance: int) -> tuple[int, int]:
    """Start and end of the longest stretch with the period ``distance`` around ``start:stop``, where words agree with those
    ``distance`` on."""
    step = FIRST_STEP
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(ids[low:start] != ids[low + distance : start + distance])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    step, last = FIRST_STEP, len(ids) - distance
    while stop < last:
        high = min(last, stop + step)
        differ = np.flatnonzero(ids[stop:high] != ids[stop + distance : high + distance])
        if len(differ):
            stop += int(differ[0])
            break
        stop, step = high, 2 * step
    return start, stop + distance


def occurrences(ids: np.ndarray, starts: np.ndarray, size: int, reach: int) -> Iterator[tuple[list[int], list[int]]]:
    """For each different block of ``size`` words among those at ``starts`` (in order): its aligned starts, and all its
    starts from there to ``reach`` words behind any aligned one."""
    aligned = defaultdict(list)
    for p in starts.tolist():
        aligned[tuple(ids[p : p + size].tolist())].append(p)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, block in enumerate(aligned):
        automaton.add_word(block, number)
    automaton.make_automaton()
    found: list[list[int]] = [[] for _ in aligned]
    ends = np.minimum(starts + reach + size, len(ids))
    breaks = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    for low, high in zip(starts[np.concatenate([[0], breaks])].tolist(), ends[np.concatenate([breaks - 1, [-1]])].tolist()):
        for end, number in automaton.iter(tuple(ids[low:high].tolist())):
            found[number].append(low + end + 1 - size)
    yield from zip(aligned.values(), found)


def seeds_of(ids: np.ndarray, aligned: list[int], places: list[int], size: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(start, distance) of pairs of occurrences of a block that can lie in a run with a period from low to high.

    Occurrences at most half a block apart are ``period`` apart, the block's own, and belong to one stretch with that period.
    """
    groups: list[list[int]] = []
    period = 0
    for at in places:
        if groups and at - groups[-1][1] <= size // 2:
            period = at - groups[-1][1]
            groups[-1][1] = at
        else:
            groups.append([at, at])
    spans = [extent(ids, first, last + size - period, period) if period else (first, first) for first, last in groups]
    firsts = [first for first, _ in groups]
    for p in aligned:
        mine = bisect_left(firsts, p + 1) - 1
        if low <= period <= high and groups[mine][0] < groups[mine][1]:
            yield groups[mine][0], period
        for other in range(mine + 1, len(groups)):
            first, last = groups[other]
            if first > p + high:
                break
            for distance in {spans[other][0] - spans[mine][0], spans[other][1] - spans[mine][1]}:
                if low <= distance <= high and first <= p + distance <= last and (not period or (p + distance - first) % period == 0):
                    yield p, distance


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start and period.

    ``least`` and ``periods`` have to be 24 and 3 at least, since the blocks are chosen for such runs.
    """
    if least < LEAST_WORDS or periods < LEAST_PERIODS:
        raise ValueError(f"runs of {least} words or {periods} periods can be too short for blocks")
    n = len(ids)
    if n < least:
        return []
    far = recurrence(ids)
    if far.min() > n // periods:
        return []
    runs: dict[tuple[int, int], int] = {}
    covered = np.zeros(n, dtype=np.int64)
    size, low = SMALLEST, 1
    while periods * low <= n:
        high = 2 * size - 1
        blocks = n // size
        gaps = np.concatenate([far, np.zeros(SMALLEST - 1, dtype=np.int64)])[: blocks * size].reshape(blocks, size)
        starts = np.flatnonzero(gaps[:, : size - SMALLEST + 1].max(axis=1) <= high) * size
        starts = starts[covered[starts] < np.minimum(starts + high + size, n)]
        if len(starts):
            seeds = {(d, p) for aligned, places in occurrences(ids, starts, size, high) for p, d in seeds_of(ids, aligned, places, size, low, high)}
            before, until = 0, 0
            for d, p in sorted(seeds):
                if d == before and p < until:
                    continue  # lies in the stretch that was extended last
                start, end = extent(ids, p, p + size, d)
                before, until = d, end - d
                if end - start >= max(least, periods * d):
                    runs.setdefault((start, end), d)
                    covered[start:end] = np.maximum(covered[start:end], end)
        size, low = 2 * size, high + 1
    return sorted((start, end - start, period) for (start, end), period in runs.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run, or only in the first period of the runs that they are in."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs array<struct<start, length, period>>, collapsed)`` of every document.

    Words are what ``\\x20`` and ``\\x09-\\x0D`` divide, numbered from 0; runs are in order of start and period.  ``collapsed``
    is the text without what runs repeat after their first period, its words joined by single spaces.  A null, empty or blank
    text has no words, no runs and an empty collapsed text.  Repeated rows each give a row; an id may be null; an empty table
    gives no rows.
    """

    def task(parts):
        for keys, texts in parts:
            rows = []
            for key, text in zip(keys, texts):
                words = (text or "").encode().split()
                runs = runs_of(numbers_of(words))
                if runs:
                    kept = [w for w, stays in zip(words, kept_words(len(words), runs).tolist()) if stays]
                else:
                    kept = words
                rows.append((key, len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept).decode()))
            yield [list(c) for c in zip(*rows)]

    return map_batches(docs, [id_col, text_col], f"{id_col} long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string", task)


def words_column(text: Column) -> Column:
    """The words of a text; none of a null one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def loop_tails(docs: DataFrame, one_in: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a loop planted in every tenth text, as a generator that is stuck would write it: a test of recall.

    With ``h`` the CRC-32 of the decimal id, ``g = h div 10`` and ``n`` words, texts with ``h % 10 = 0`` repeat from word
    ``a = g % n`` on the ``p = 1 + (n - a) div (3 + g % 8)`` words there, to the old number of words.  Texts without words,
    those with a null id and all others stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    marked = docs.withColumn("__words", F.when(h % one_in == 0, words_column(F.col(text_col))))
    sized = marked.withColumn("__n", F.size("__words")).withColumn("__g", F.floor(h / one_in).cast("long"))
    at = F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int")
    placed = sized.withColumn("__a", at)
    placed = placed.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    times = F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")).cast("int")
    looped = F.concat(F.slice("__words", 1, F.col("__a")), F.flatten(F.array_repeat(F.slice("__words", F.col("__a") + 1, F.col("__p")), times)))
    text = F.when(F.col("__n") > 0, F.array_join(F.slice(looped, 1, F.col("__n")), " ")).otherwise(F.col(text_col))
    return placed.withColumn(text_col, text).select(*[quoted(c) for c in docs.columns])


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the run that repeats most often, and digests of all runs and of the collapsed text.

    ``found`` is a table of :func:`find_runs`.  Of runs with the same exact length by period the first counts.
    """
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return told.select(id_col, "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
