"""Operators on pairs and the fitted models."""

import io
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from fathom.llm import byte_cnn, language, pseudonyms, simhash, vectors
from fathom.llm.graph import DisjointSets, connected_components
from tests.llm.edge import edge_docs, edge_rows, no_docs

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def least_reachable(n, linked, ids):
    sets = DisjointSets(n)
    for i, j in linked:
        sets.join(i, j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            root = sets.find(i)
            least[root] = min(least.get(root, ids[i]), ids[i])
    return [least.get(sets.find(i)) for i in range(n)]


def test_connected_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 7), (7, 6), (20, 19), (20, 19)] + [(100, n) for n in range(101, 160)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 19: 19, 20: 19} | {n: 100 for n in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# Operator 3


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t or "") for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    return prints, least_reachable(len(rows), linked, [i for i, _ in rows])


def test_near_duplicates_on_edge_rows(spark):
    rows = [r[:2] for r in edge_rows()]
    prints, components = brute_components(rows)
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    assert Counter(map(tuple, got)) == Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, components))
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**12])
def test_trie_join_by_brute_force(n):
    rng = np.random.default_rng(0)
    values = np.repeat(rng.integers(0, 2**63, size=40, dtype=np.uint64), 30)
    for _ in range(5):
        values ^= (np.uint64(1) << rng.integers(0, 64, size=len(values)).astype(np.uint64)) * (rng.random(len(values)) < 0.7).astype(np.uint64)
    values = np.unique(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if i < j}
    got = set()
    for front, behind in simhash.plan_tries(n):
        depth = sum(b for _, b in front)
        turned = simhash.rotate(values, front + behind)
        order = np.argsort(turned)
        turned = turned[order]
        top = turned >> np.uint64(64 - depth)
        starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        stops = np.append(starts[1:], len(top))
        for i, j in simhash.join_tries(turned, depth, np.stack([starts, stops, starts, stops], 1)):
            got |= {tuple(sorted((int(order[a]), int(order[b])))) for a, b in zip(i, j)}
    assert got == want


@pytest.mark.parametrize("group_rows", [4, 4096])
def test_large_groups_are_divided(spark, group_rows):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, size=6, dtype=np.uint64)
    values = np.unique(np.concatenate([center[:, None] ^ (np.uint64(1) << rng.integers(0, 64, size=(6, 60)).astype(np.uint64)) for _ in range(2)]).ravel())
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    sets = DisjointSets(len(values))
    place = {int(v): n for n, v in enumerate(values.view(np.int64))}
    for r in simhash.near_links(nodes, group_rows=group_rows).collect():
        assert (r.u & (2**64 - 1) ^ r.v & (2**64 - 1)).bit_count() >= 1
        sets.join(place[r.u], place[r.v])
    linked = zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4))
    assert [sets.find(i) for i in range(len(values))] == least_reachable(len(values), linked, list(range(len(values))))


# Operator 5


def test_pseudonyms_keep_form_and_links(spark):
    values = ["Ann.b1@mail5.example.com", "10.0.0.255", "2024-02-29", "31/12/1999", "+1 (743) 555-3824", "123-45-6789", "4111 1111 1111 1111", "4111111111111111", "4785380592391139"]
    docs = spark.createDataFrame([(n, f"see {v}, then {v}.") for n, v in enumerate(values)] + [(99, "on 30/02/2020 or 1.2.3.4.5 or 12"), (None, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    shapes = [r"[A-Z][a-z]{2}\.[a-z][0-9]@[a-z]{4}[0-9]\.[a-z]{7}\.com", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", r"\d{4}-\d\d-\d\d", r"\d\d/\d\d/\d{4}", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\d{3}-\d\d-\d{4}", r"(?:\d{4} ){3}\d{4}", r"\d{16}", r"\d{16}"]
    fresh = []
    for n, (value, shape) in enumerate(zip(values, shapes)):
        m = re.fullmatch(rf"see ({shape}), then ({shape})\.", rows[n].text)
        assert m and m[1] == m[2] and value not in rows[n].text, rows[n]
        fresh.append(m[1])
        assert sum(rows[n][2:]) == 2
    assert fresh[6].replace(" ", "") == fresh[7]
    luhn = lambda s: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10
    assert luhn(fresh[7]) == luhn(values[7]) and luhn(fresh[8]) == luhn(values[8])
    assert all(int(x) < 256 for x in fresh[1].split("."))
    assert rows[99].text == "on 30/02/2020 or 1.2.3.4.5 or 12" and rows[None].text is None
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "another key").collect()}
    assert all(other[n] != rows[n].text for n in range(len(values)))


def test_pseudonyms_are_permutations(spark):
    texts = [(n, f"10.{n // 256}.{n % 256}.7") for n in range(3000)] + [(n, f"000{n:013d}") for n in range(3000)]
    texts += [(n, str(np.datetime64("1995-01-01") + n)) for n in range(3000)] + [(n, f"{n % 1000:03d}-{n // 1000:02d}-0001") for n in range(3000)]
    out = [r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == len(set(t for _, t in texts)) == 12000
    # dates: the whole domain maps onto itself
    days = spark.range(pseudonyms.DAYS_A * pseudonyms.DAYS_B).select("id", F.expr(f"date_format(date_add(date'{pseudonyms.FIRST_DAY}', cast(id as int)), 'yyyy-MM-dd')").alias("day"))
    image = days.select("day", F.expr(pseudonyms.date("day", "k")).alias("fresh"))
    assert image.select("fresh").distinct().count() == days.count() == image.select("fresh").intersect(days.select("day")).count()


def test_pseudonyms_on_edge_rows(spark):
    rows = pseudonyms.pseudonymise(edge_docs(spark), "k").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(r[:2] for r in edge_rows())
    assert pseudonyms.pseudonymise(no_docs(spark), "k").count() == 0


# Operator 8


def brute_vectors(rows, threshold=0.93):
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(r[1]) if k else None for r, k in zip(rows, ok)]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    n = Counter(i for pair in linked for i in pair)
    return n, least_reachable(len(rows), linked, [r[0] for r in rows])


@pytest.mark.parametrize("cell_rows", [16, 1024])
def test_near_vectors_by_brute_force(spark, cell_rows):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    data = np.concatenate([base, *[base + rng.normal(size=base.shape) * s for s in (0.02, 0.1, 0.2, 0.3)], base[:10], base[:10] * 3, base[0] + rng.normal(size=(40, 24)) * 0.1])
    rows = [(n, [float(np.float32(x)) for x in v], n % 2) for n, v in enumerate(data)]
    odd = [None, [], [0.0] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0] * 24, [1.0] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + n, v, 1) for n, v in enumerate(odd)] + [(2000, rows[0][1], None), (0, rows[0][1], 0), (None, rows[0][1], 0)]
    docs = spark.createDataFrame([(*r, 7, b"z") for r in rows], "vec_id long, embedding array<float>, label int, n int, copy binary")
    n_links, components = brute_vectors(rows)
    got = vectors.near_vectors(docs, cell_rows=cell_rows).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], n_links[i], components[i], r[0] is not None and r[0] == components[i]) for i, r in enumerate(rows))
    found, total = sum(r.n_links for r in got), sum(n_links.values())
    assert 0.97 * total <= found <= total
    # what differs must be vectors with a link near the threshold
    assert sum((want - Counter(map(tuple, got))).values()) <= 0.05 * len(rows)
    assert vectors.near_vectors(docs.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1)[:, None]
    x, y = vectors.all_cells(a), vectors.all_cells(b)
    meet = ((x == y[:, :, :1]).any(axis=2) | (y == x[:, :, :1]).any(axis=2)).any(axis=1)
    assert meet.mean() >= 0.97


def test_lattice_decoding():
    x = np.random.default_rng(5).normal(size=(500, 8)) * 2
    point = vectors.nearest_e8(x)
    doubled = np.rint(2 * point).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1) & (doubled.sum(axis=1) % 4 == 0)).all()
    off = ((x - point) ** 2).sum(axis=1)
    for v in vectors.NEIGHBOURS:
        assert (off <= ((x - point - v) ** 2).sum(axis=1) + 1e-9).all()


# Operators 9 and 10


def test_network_gradients():
    net, text = byte_cnn.ByteNetwork(), ("the quick brown fox " * 30).encode()
    grad = {k: np.zeros_like(v) for k, v in net.p.items()}
    table = np.zeros_like(net.table)
    net._gradients(text, 1.0, grad, table)
    grad["emb"] = np.einsum("wbf,wef->be", table, net.p["conv"])
    grad["conv"] = np.einsum("be,wbf->wef", net.p["emb"], table)

    def loss(name, at, by):
        other = byte_cnn.ByteNetwork({k: v.astype(np.float64).copy() for k, v in net.p.items()})
        other.p[name][at] += by
        other._tables()
        return -np.log(other.score(text.decode()))

    for name, at in (("conv", (2, 3, 4)), ("emb", (ord("q"), 1)), ("out", (3,)), ("out", (byte_cnn.FILTERS + 2,)), ("bias", (1,)), ("shift", (0,))):
        slope = (loss(name, at, 1e-2) - loss(name, at, -1e-2)) / 2e-2
        assert abs(slope - grad[name][at]) < 2e-2 * max(1, abs(slope)) + 2e-3


def test_scores_by_plain_convolution():
    """The network spelled out: embed, convolve, rectify, maxima of overlapping chunks, mean and maximum, one unit."""
    rng = np.random.default_rng(9)
    net = byte_cnn.ByteNetwork()
    net = byte_cnn.ByteNetwork({k: v + rng.normal(0, 0.1, v.shape) for k, v in net.p.items()})
    for n in (0, 1, 4, 5, 127, 128, 129, 255, 256, 257, 900):
        text = "".join(rng.choice(list("ab é.\n字")) for _ in range(n))
        codes = text.encode() + bytes(byte_cnn.WIDTH - 1) if text else bytes(byte_cnn.WIDTH)
        at = range(len(codes) - byte_cnn.WIDTH + 1)
        out = np.array([sum(net.p["emb"][codes[i + w]] @ net.p["conv"][w] for w in range(byte_cnn.WIDTH)) + net.p["bias"] for i in at])
        chunks = [out[i : i + 2 * byte_cnn.HALF] for i in range(0, max(1, len(out) - byte_cnn.HALF), byte_cnn.HALF)]
        maxima = np.maximum([c.max(axis=0) for c in chunks], 0)
        z = np.concatenate([maxima.mean(axis=0), maxima.max(axis=0)]) @ net.p["out"] + net.p["shift"][0]
        assert net.score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_the_sample_is_bounded_and_fixed(spark):
    docs, labels = labelled(spark)
    long = spark.createDataFrame([(n, "x" * (byte_cnn.SAMPLE_CHARS + n % 2)) for n in (3, 4, 7, 8)], "doc_id long, text string")
    many = docs.select("doc_id", "text").unionByName(docs.select("doc_id", F.concat("text", F.lit("!")).alias("text"))).unionByName(long)
    sample = byte_cnn.labelled_sample(many, labels, sample={0: 200, 1: 200})
    assert 200 <= len(sample) <= 480
    assert sample == byte_cnn.labelled_sample(many.repartition(7), labels.repartition(5), sample={0: 200, 1: 200})
    assert max(len(t) for t, _ in sample) <= byte_cnn.SAMPLE_CHARS
    assert len(byte_cnn.labelled_sample(many, labels, sample={0: 30, 1: 30})) <= 72


def test_long_texts_are_scored_in_blocks(monkeypatch):
    net, text = byte_cnn.ByteNetwork(), "some words with ends. " * 3000
    whole = net.score(text)
    monkeypatch.setattr(byte_cnn, "BLOCK", 1024)
    assert net.score(text) == pytest.approx(whole, abs=1e-5)


def fold(doc_id):
    return crc32(str(doc_id).encode()) % 5


def labelled(spark):
    good, bad = "This is a quiet line of plain prose, number {}. ", "BUY!! NOW!! {} CHEAP!! "
    rows = [(n, (good if n % 2 else bad).format(n) * (1 + n % 7)) for n in range(400)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, label int")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic").unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int"))


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    model = byte_cnn.train(docs, labels)
    rows = byte_cnn.score_quality(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {n for n in range(400) if fold(n) == 0}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert len(byte_cnn.labelled_sample(docs, labels, sample={0: 20, 1: 20})) <= 48
    assert all(fold(int(re.search(r"\d+", t)[0])) for t, _ in byte_cnn.labelled_sample(docs, labels))


def test_quality_on_edge_rows(spark):
    docs, labels = labelled(spark)
    model = byte_cnn.train(docs, labels)
    rows = byte_cnn.score_quality(edge_docs(spark), model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
    net = byte_cnn.ByteNetwork.loads(model)
    kept = byte_cnn.keep_quality(edge_docs(spark), model)
    assert kept.schema == edge_docs(spark).schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, *_ in edge_rows() if net.score(t or "") >= 0.3)
    assert byte_cnn.score_quality(no_docs(spark), model).count() == 0
    untrained = byte_cnn.train(no_docs(spark), labels.limit(0))
    assert {r.score for r in byte_cnn.score_quality(docs, untrained).collect()} == {0.5}


def test_forward_sums_all_segmentations():
    pieces = language.pieces_of(PIECES)
    rng = np.random.default_rng(0)
    probability = rng.random((pieces.size, 2)) / 100
    number = {k: pieces.automaton.get(k) // 256 for k in pieces.automaton.keys()}

    def brute(word):
        text = "▁" + word
        total = [np.zeros(2)]  # logarithms
        for j in range(1, len(text) + 1):
            total.append(total[-1] + language.UNKNOWN)
            for i in range(max(0, j - pieces.longest), j):
                if text[i:j] in number:
                    total[j] = np.logaddexp(total[j], total[i] + np.log(probability[number[text[i:j]]]))
        return total[-1]

    words = ["the", "éçàque", "x", "字", "hello", "thanonontioniner", "ß字q"]
    words += [letters[:n] for letters in ("a" * 200, "the" * 70, "字" * 200, "字the" * 50) for n in (29, 30, 31, 32, 33, 47, 63, 64, 65, 96, 127, 200)]
    assert np.allclose(pieces.forward(words, probability), [brute(w) for w in words])
    assert np.allclose(pieces.forward(["the" * 4000, "字" * 5000], probability), [brute("the" * 4000), brute("字" * 5000)])


def test_expectations_add_up():
    """Each word's expected pieces cover its characters, so one round keeps every language's weight."""
    pieces = language.pieces_of(PIECES)
    expect = np.zeros((pieces.size, 1))
    words = ["hello", "world", "segmentation"]
    words += ["the" * 40, "字the" * 30]
    pieces.run(words, np.full((pieces.size, 1), 1 / pieces.size), expect, np.array([[2.0], [1.0], [3.0], [5.0], [7.0]]))
    lengths = np.zeros(pieces.size)
    for k in pieces.automaton.keys():
        lengths[pieces.automaton.get(k) // 256] = len(k)
    assert (expect[:, 0] * lengths).sum() == pytest.approx(2 * 6 + 6 + 3 * 13 + 5 * 121 + 7 * 121, rel=1e-3)


def test_expectations_by_differences():
    """Expected counts are the slopes of the words' log probabilities; on both sides of a change of scale."""
    pieces = language.pieces_of(PIECES)
    rng = np.random.default_rng(3)
    probability = rng.random((pieces.size, 1)) / 1000
    words = ["the" * n for n in (5, 10, 11, 22, 40)]
    expect = np.zeros_like(probability)
    pieces.run(words, probability, expect, np.ones((len(words), 1)))
    for piece in ("the", "he", "t", "ethe", "th"):
        if not pieces.automaton.exists(piece):
            continue
        n = pieces.automaton.get(piece) // 256
        more, less = probability.copy(), probability.copy()
        more[n] *= 1.001
        less[n] *= 0.999
        slope = (pieces.forward(words, more) - pieces.forward(words, less)).sum() / 0.002
        assert expect[n, 0] == pytest.approx(slope, rel=1e-4, abs=1e-8)


def test_language_of_long_texts():
    """A run of a hundred thousand letters is one lattice, and its languages compare like those of its parts."""
    pieces = language.pieces_of(PIECES)
    probability = np.full((pieces.size, 2), 1e-4)
    probability[pieces.automaton.get("the") // 256] = 0.1, 0.01
    out = pieces.forward(["the" * 33_000], probability)
    assert np.isfinite(out).all() and out[0, 0] > out[0, 1] + 30_000


def test_language(spark):
    lines = {"en": "the cat and the other thing were with that house", "de": "der hund und die katze sind nicht in dem haus", "fr": "le chat est dans la maison avec les autres"}
    rng = np.random.default_rng(1)
    rows = [(n, " ".join(rng.permutation(lines[lang].split())[:6]), lang, "s") for n, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows + [(900, "the", None, None), (901, None, "de", "s"), (None, "der hund", "de", "s")], "doc_id long, text string, lang string, source string")
    model = language.fit(docs, PIECES)
    got = {r.doc_id: r for r in language.identify_languages(docs, model, PIECES).collect()}
    assert np.mean([got[n].lang_pred == lang for n, _, lang, _ in rows if got[n].held_out]) > 0.95
    assert got[901].lang_pred == "und" and got[900].lang_pred == "en" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())
    edge = language.identify_languages(edge_docs(spark), model, PIECES).collect()
    want = {i for i, t, *_ in edge_rows() if t is None or not any(map(str.isalpha, t))}
    assert {r.doc_id for r in edge if r.lang_pred == "und"} >= {0, 1, 2, 4, 5, 11} and {r.doc_id for r in edge if r.lang_pred == "und"} <= want
    assert len(edge) == len(edge_rows())
    assert language.identify_languages(no_docs(spark), model, PIECES).count() == 0
    empty = language.fit(no_docs(spark), PIECES)
    assert {r.lang_pred for r in language.identify_languages(docs, empty, PIECES).collect()} == {"und"}


def test_predictions_by_plain_sums(spark):
    """Documents' languages and posteriors from every word's segmentations, counted out one by one."""
    pieces = language.pieces_of(PIECES)
    rng = np.random.default_rng(6)
    langs = ["aa", "bb", "cc"]
    probability = rng.random((pieces.size, 3)).astype(np.float32) / 1000
    np.savez(out := io.BytesIO(), probability=probability, languages=np.array(langs))
    number = {k: pieces.automaton.get(k) // 256 for k in pieces.automaton.keys()}

    def brute(word, start):
        """Log probability of the rest of a word by recursion over its first piece."""
        if start == len(word):
            return np.zeros(3)
        if (word, start) not in known:
            total = brute(word, start + 1) + language.UNKNOWN
            for end in range(start + 1, len(word) + 1):
                if word[start:end] in number:
                    total = np.logaddexp(total, np.log(probability[number[word[start:end]]].astype(float)) + brute(word, end))
            known[word, start] = total
        return known[word, start]

    known = {}
    texts = ["The cat", "ein Haus, das 3 steht!", "x" * 60 + " y", "l'été dernier", "12 ½ ...", "word " * 50, None, "mot-à-mot naïve"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify_languages(docs, out.getvalue(), PIECES).collect()}
    for n, text in enumerate(texts):
        words = re.findall(r"[a-zà-ÿ]+", (text or "").lower())
        total = sum((brute("▁" + w, 0) for w in words), np.zeros(3))
        if not words:
            assert (got[n].lang_pred, got[n].score) == ("und", 0.0)
            continue
        assert got[n].lang_pred == langs[int(total.argmax())]
        assert got[n].score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)


def test_pieces_come_from_the_vocabulary():
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    spelled = {processor.id_to_piece(i).lower() for i in range(processor.get_piece_size())}
    assert set(language.pieces_of(PIECES).automaton.keys()) <= spelled
