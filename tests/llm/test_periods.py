"""Operator 11 against a search that compares all words at all distances."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fathom.llm.periods import find_runs, kept_words, loop_tails, numbers_of, run_digests, runs_of
from tests.llm.edge import SCHEMA, edge_docs, edge_rows, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, periods=3):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def looping(rng):
    """Loops in loops over few words, with breaks."""
    k, n, out = rng.choice([1, 2, 2, 3, 5, 50]), rng.randint(0, 300), []
    while len(out) < n:
        unit = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 31, 33, 40]))]
        for _ in range(2):
            if rng.random() < 0.3:
                unit = unit * rng.randint(2, 5) + [rng.randrange(k)] * rng.randrange(12)
        out += unit * rng.randint(1, 6) + [rng.randrange(k) for _ in range(rng.randrange(4))]
    return out[: n + rng.randrange(3)]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs(seed):
    rng = random.Random(seed)
    for _ in range(250):
        words = looping(rng)
        assert runs_of(np.array(words, dtype=np.int64)) == brute_runs(words), words


@pytest.mark.parametrize("length", [23, 24, 25, 47, 48, 49])
def test_shortest(length):
    words = [n % 16 for n in range(length)]
    assert runs_of(np.array(words)) == brute_runs(words)
    assert runs_of(np.zeros(length, dtype=np.int64)) == ([(0, length, 1)] if length >= 24 else [])


def test_bounds_are_told():
    with pytest.raises(ValueError):
        runs_of(np.zeros(30, dtype=np.int64), periods=2)


def test_work_on_texts_that_repeat():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    assert runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    assert len(runs_of(np.array(([0] * 1000 + [1]) * 100))) == 101
    runs = runs_of(np.array(fib[-1]))
    assert len(runs) > 1000 and all(n >= max(24, 3 * q) for _, n, q in runs)


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = (None,) * 4
    for s, m, q in runs:
        if best[0] is None or m * best[2] > best[1] * q:
            best = (s, m, q, 1000 * m // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def rows_of(docs):
    return sorted(map(tuple, run_digests(find_runs(loop_tails(docs))).collect()), key=str)


def test_query_on_rows(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choice(["al", "be", "été", "\x1f", "\x85"]) + str(w % 7) for w in looping(rng)) for _ in range(150)]
    rows = [(n * 7, t) for n, t in enumerate(texts)] + [(n, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 200)))) for n in range(2000, 2150)]
    assert sum(zlib.crc32(str(n).encode()) % 10 == 0 for n, _ in rows) > 10
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((brute_row(*r) for r in rows), key=str)


def test_edge_rows(spark):
    small = [r for r in edge_rows() if len(r[1] or "") < 4000]
    assert rows_of(spark.createDataFrame(small, SCHEMA)) == sorted((brute_row(r[0], r[1]) for r in small), key=str)
    assert len(rows_of(edge_docs(spark))) == len(edge_rows())
    assert rows_of(no_docs(spark)) == []
    assert loop_tails(edge_docs(spark)).columns == edge_docs(spark).columns


def test_texts_of_operator(spark):
    words = "one two " + "a b c d e f g h " * 5 + "end"
    row = find_runs(spark.createDataFrame([(1, words.replace(" ", "\n"))], "doc_id long, text string")).first()
    assert row.collapsed == "one two a b c d e f g h end" and [tuple(r) for r in row.runs] == [(2, 40, 8)] and row.n_words == 43
    assert kept_words(5, []).all() and len(numbers_of([])) == 0
