"""The pipeline's near-copy stage by brute force on edited copies."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fathom.llm import near_copies, queries, secrets, simhash
from tests.llm.edge import edge_docs, edge_rows, no_docs
from tests.llm.test_groups import least_reachable

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Smallest id of each component of pairs with Jaccard >= 0.8; ids are distinct."""
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return Counter(set(least_reachable(len(rows), linked, [i for i, _ in rows])))


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def edited_copies():
    rng = random.Random(7)
    rows = []
    for n in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(100 * n + k, edited(rng, words, k)) for k in (0, 2, 4, 6, 12, 20)]
    return rows


def test_edited_copies_leave_one(spark):
    rows = edited_copies()
    want = brute_kept(rows)
    assert 60 < sum(want.values()) < 200
    got = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == want


def test_large_tables_are_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SENT_ROWS", 0)
    monkeypatch.setattr(near_copies, "STAR_ROWS", 2)
    rows = edited_copies()[:120]
    got = Counter(r.doc_id for r in near_copies.keep_representatives(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_kept(rows)


@pytest.mark.parametrize("group_rows", [3, 256])
def test_groups_with_several_components_are_compared_in_all_pairs(spark, monkeypatch, group_rows):
    # one band of one minimum: texts with a common passage meet, and few of them are similar to the first
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: np.zeros(near_copies.BANDS, dtype=np.int64)[:1])
    rows = edited_copies()[:90]
    got = Counter(r.doc_id for r in near_copies.keep_representatives(spark.createDataFrame(rows, SCHEMA), group_rows=group_rows).collect())
    assert got == brute_kept(rows)


def test_edge_rows(spark):
    kept = near_copies.keep_representatives(edge_docs(spark))
    assert kept.schema == edge_docs(spark).schema
    sets = [shingles(r[1]) for r in edge_rows()]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(least_reachable(len(sets), linked, [r[0] for r in edge_rows()])))
    assert near_copies.keep_representatives(no_docs(spark)).count() == 0


def test_budget_of_the_tries():
    """Pairs at the similarity are within the budget, for small sets too."""
    rng = np.random.default_rng(8)
    over = 0
    for n in (5, 10, 45, 180):
        for _ in range(3000):
            all_ = rng.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=n).astype(np.uint64)
            only = n // 5  # of these, any number may be on one side
            left = rng.integers(0, only + 1)
            a, b = all_[: n - left], np.concatenate([all_[: n - only], all_[n - left :]])
            assert near_copies.similar(np.unique(a), np.unique(b))
            over += (simhash.fingerprint_of(a) ^ simhash.fingerprint_of(b)).bit_count() > near_copies.DIFFER
    assert over <= 2


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8)], "doc_id long, text string, row int, ROW_ int")
    assert near_copies.keep_representatives(docs).collect() == docs.where("doc_id = 1").collect()


def test_stage_and_those_behind_it_on_the_small_table(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    docs = queries.table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(kept.keys()) == brute_kept(list(before.items())) and all(before[i] == t for i, t in kept.items())
    clean = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, small).collect()}
    assert clean == {i: secrets.redact(t, secrets.all_spans(t)[1]) for i, t in kept.items()}


def test_rows_are_numbered_once(spark, tmp_path, monkeypatch):
    """Splits of the files change between the jobs, as when executors come or go."""
    rows = [(n, f"text {n % 50} of a few words") for n in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(40).write.parquet(str(tmp_path / "docs"))
    before, cut, calls = spark.conf.get("spark.sql.files.openCostInBytes"), near_copies.cut_lineage, []

    def moved(df):
        out = cut(df)
        calls.append(1)
        spark.conf.set("spark.sql.files.openCostInBytes", "1g" if len(calls) % 2 else "1")
        return out

    monkeypatch.setattr(near_copies, "cut_lineage", moved)
    try:
        got = Counter(r.doc_id for r in near_copies.keep_representatives(spark.read.parquet(str(tmp_path / "docs"))).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert got == Counter(range(50))


def test_first_links_come_from_the_tries(spark):
    """Each text's smallest partner within the budget, also where that isn't the group's smallest text, and in every part."""
    rng = np.random.default_rng(5)
    groups, nodes, prints = [], [], []
    for path in range(30):
        base = rng.integers(0, 2**64, size=3, dtype=np.uint64)
        for _ in range(rng.integers(2, 12)):
            groups.append(path)
            nodes.append(int(rng.integers(-(2**62), 2**62)))
            prints.append(base[rng.integers(3)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, size=18).astype(np.uint64)))
    prints = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    near = [(a, b) for a in range(len(nodes)) for b in range(len(nodes)) if groups[a] == groups[b] and nodes[a] < nodes[b] and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= near_copies.DIFFER]
    want = {(min(nodes[a] for a, b in near if b == v), nodes[v]) for v in {b for _, b in near}}
    firsts = {p: min(n for n, g in zip(nodes, groups) if g == p) for p in groups}
    assert len(want) > 60 and any(u not in firsts.values() for u, _ in want)
    rows = [(p, n, f, groups.count(p), firsts[p]) for p, n, f in zip(groups, nodes, prints)]
    members = spark.createDataFrame(rows, "path long, node long, fp long, n long, first long")
    assert {tuple(r) for r in near_copies._first_pairs(members, 256).collect()} == want
    # in parts: what is near the group's smallest text is paired with it all the same
    got = {tuple(r) for r in near_copies._first_pairs(members, 2).collect()}
    assert {(u, v) for u, v in want if u in firsts.values()} <= got
