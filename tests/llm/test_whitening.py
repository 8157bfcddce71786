"""Operator 12 against plain numpy, exact integers and tables that have no variance."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from fathom.llm import whitening
from fathom.llm.whitening import column_sums, deviations, fit_list, integers, tiled_covariance, whiten_vectors

TYPE = "vec_id long, embedding array<double>, label int, x string, id string, n long"


def sound(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, components=16):
    """(vec_id, component) -> what the contract says, from all rows at once."""
    xs = [(k, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for k, v in rows if sound(v)]
    listed = sorted({x for _, x in xs})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(x, mean)] for x in listed])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = defaultdict(list)
    for k, x in xs:
        white = np.array([float(c - m) for c, m in zip(x, mean)]) @ vectors / np.sqrt(values)
        for c in range(len(values)):
            out[k, c + 1].append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), white[c], values[c] / np.trace(centred.T @ centred / n)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "i", 2) for k, v in rows], TYPE)


def sample(rng, n, dims, copies):
    scales = [2 * 0.8**d for d in range(dims)]
    rows = [(k, [rng.gauss(0, s) for s in scales]) for k in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(copies)]


def check(got, want):
    found = defaultdict(list)
    for r in got:
        found[r.vec_id, r.component].append(r)
    assert set(found) == set(want)
    signs = {}
    for key in sorted(want, key=str):
        assert len(found[key]) == len(want[key])
        for r, w in zip(found[key], want[key]):
            assert (r.n, r.deviation) == w[:2]
            sign = signs.setdefault(key[1], math.copysign(1, r.whitened * w[2]))
            assert r.whitened * sign == pytest.approx(w[2], abs=1e-8)
            assert r.explained == pytest.approx(w[3], rel=1e-9)
            assert r.identity_error < 1e-9


@pytest.mark.parametrize("tile", [5, 64])
def test_against_numpy(spark, tile):
    rows = sample(random.Random(tile), 300, 23, 150)
    rows += [(900, None), (901, []), (902, [1.0] * 22 + [None]), (903, [1.0] * 22 + [math.nan]), (904, [1.0] * 22 + [math.inf]), (None, rows[1][1]), (3, rows[3][1])]
    got = whiten_vectors(table(spark, rows).repartition(7), tile=tile).collect()
    check(got, brute(rows))
    assert len(got) == 16 * (300 + 150 + 2)


def test_few_dimensions_and_floats(spark):
    rng = random.Random(2)
    rows = [(k, [float(np.float32(rng.gauss(0, 1))) for _ in range(3)]) for k in range(60)]
    want = brute(rows)
    got = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(whiten_vectors(got).collect(), want)
    assert max(c for _, c in want) == 3


def test_tables_without_variance(spark):
    assert whiten_vectors(table(spark, [])).count() == 0
    assert whiten_vectors(table(spark, [(1, None), (2, [])])).count() == 0
    assert whiten_vectors(table(spark, [])).columns == whiten_vectors(table(spark, [(1, [0.0])])).columns
    one = whiten_vectors(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(k, c, 1, 0, None, None, None) for k in (1, 2) for c in (1, 2)}
    flat = whiten_vectors(table(spark, [(1, [0.5, 0.0]), (2, [1.5, 0.0])])).collect()
    assert [(r.component, r.whitened is None, r.explained) for r in flat if r.vec_id == 1] == [(1, False, 1.0), (2, True, 0.0)]
    assert flat[0].identity_error < 1e-12


def test_other_lengths_go(spark):
    rows = sample(random.Random(4), 20, 4, 0)
    got = whiten_vectors(table(spark, rows + [(100, [1.0]), (101, [1.0, 2.0])])).collect()
    check(got, brute(rows))


def test_large_numbers_stay_exact():
    x = np.array([[10**15, -(10**15)], [3, 4]], dtype=np.int64)
    sums, n = [int(s) for s in x.astype(object).sum(axis=0)], 2
    assert deviations(x, n, sums) == [None, None]
    small = np.array([[1_000_003, 999_000], [999_999, 1_000_500]], dtype=np.int64)
    sums = [int(s) for s in small.sum(axis=0)]
    assert deviations(small, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in small]
    many = 3_000_000_000
    assert deviations(small[:1], many, [10**6 * many + 7, 999_000 * many]) == [(3 * many - 7) ** 2 if (3 * many - 7) ** 2 < 2**63 else None]


def test_entries_of_any_size(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    got = whiten_vectors(table(spark, rows)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)


def test_tiles_are_the_covariance(spark):
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(0, 3, (500, 17)))]
    fit = fit_list(integers(table(spark, rows)).select("x")).repartition(5)
    n, sums = column_sums(fit)
    x = np.array([r.x for r in fit.collect()])
    assert n == 500 and sums == x.sum(axis=0).tolist()
    for tile, rows_of_block in ((4, 7), (17, 100), (16, 1000)):
        assert np.allclose(tiled_covariance(fit, n, sums, tile, rows_of_block), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)


def test_most_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 3)
    with pytest.raises(ValueError, match="at most"):
        whiten_vectors(table(spark, sample(random.Random(1), 4, 4, 0)))
