import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from fathom.llm import line_rules, packing, secrets, token_counts
from fathom.llm.bpe import encoder
from fathom.llm.codec import codec_digests, encode_documents
from fathom.llm.line_rules import clean_documents
from fathom.llm.packing import pack_documents
from fathom.llm.secrets import scan_secrets
from fathom.llm.token_counts import CountedDocument, count_tokens, pretoken_counts
from tests.llm.edge import edge_docs, edge_rows, no_docs

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def by_row(rows):
    """Rows by id as a multiset, since ids repeat."""
    return Counter(rows)


# Operator 7


@pytest.mark.parametrize("alphabet", [" \n\t\r  abcdefThe'sllve0123.,!?éüñß\x1c\x85字😀́½Ⅷ²", "etaoinshr", ["<|endoftext|>", " the", "The", " ", "\n", "1", "  ", "'s", "é", "!!"]])
def test_encoder_equals_the_library(alphabet):
    library, own, rng = Tokenizer.from_file(BYTE_BPE), encoder(BYTE_BPE), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_codec_on_edge_rows(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    want = []
    for doc_id, text, *_ in edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert decoded == (text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert by_row(map(tuple, codec_digests(edge_docs(spark), BYTE_BPE).collect())) == by_row(want)
    assert all(r.decoded == (t or "") for r, t in zip(encode_documents(edge_docs(spark), BYTE_BPE).collect(), [r[1] for r in edge_rows()]))
    assert codec_digests(no_docs(spark), BYTE_BPE).count() == 0


# Operator 2


def test_word_tokenizer_equals_the_library():
    library, own, rng = Tokenizer.from_file(WORD_BPE), packing.WordTokenizer(WORD_BPE), random.Random(2)
    alphabet = " \n\t  abcdefThe'sllve0123.,!?éüñßİſÀ½²\x0b\x1c\x85\xa0\xad字😀́_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [f"x{chr(c)}y {chr(c)}." for c in range(1, 0x180)] + ["<|endoftext|> a", "A" * 20_000, "foo's foo's. foo'... 'll"]
    for at in range(0, len(texts), 500):
        for text, data in zip(texts[at:], own.batch(texts[at : at + 500])):
            assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    own, library = packing.WordTokenizer(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    texts = [f"word{n} other{n % 7}." for n in range(200)]
    out = [x for at in range(0, 200, 10) for x in own.batch(texts[at : at + 10])]
    assert [np.frombuffer(x, "<u4").tolist() for x in out] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.cache) <= 100


def check_packing(rows, docs, capacity):
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple(library.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for doc_id, parts in pieces.items():
        for (d, ids), n in want.items():
            if d == doc_id:
                assert sum(tuple(p.ids) == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids) for p in parts) >= n
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    return padding


def test_packing_on_edge_rows(spark):
    docs = edge_docs(spark).repartition(3)
    assert check_packing(pack_documents(docs, WORD_BPE).collect(), [r[:2] for r in edge_rows()], 2048) == 0
    assert check_packing(pack_documents(docs, WORD_BPE, capacity=64).collect(), [r[:2] for r in edge_rows()], 64) == 0
    assert check_packing(pack_documents(docs, WORD_BPE, capacity=100).collect(), [r[:2] for r in edge_rows()], 100) == 0
    assert pack_documents(no_docs(spark), WORD_BPE).count() == 0


@pytest.mark.parametrize("capacity", [2048, 2000, 97])
def test_every_bin_holds_a_fixed_number_of_pieces(capacity):
    packer, filled, pieces = packing.HarmonicPacker(capacity), [], 0
    rng = random.Random(5)
    for doc in range(3000):
        n = rng.randint(1, 2 * capacity)
        filled += list(packer.add(doc, bytes(4 * n)))
    for _, bin_ in filled:
        lengths = [len(data) // 4 for (_, _, data, _), _ in bin_]
        assert sum(lengths) == capacity and max(lengths) - min(lengths) <= 1
        assert {capacity // len(bin_), -(-capacity // len(bin_))} >= set(lengths)
        pieces += len(bin_)
    assert pieces < 4 * 3000
    rest = list(packer.finish())
    assert sum(sum(len(data) // 4 for (_, _, data, _), _ in bin_) < capacity for _, bin_ in rest) <= capacity.bit_length()
    assert [number for number, _ in filled + rest] == list(range(len(filled) + len(rest)))


def test_packing_ends_for_every_capacity():
    for capacity in range(1, 201):
        packer, rng, got = packing.HarmonicPacker(capacity), random.Random(capacity), defaultdict(list)
        sizes = [rng.randint(1, 3 * capacity) for _ in range(rng.randint(0, 12))]
        filled = [s for doc, n in enumerate(sizes) for s in packer.add(doc, np.arange(n, dtype="<u4").tobytes())]
        for _, bin_ in filled + list(packer.finish()):
            size = sum(len(data) // 4 for (_, _, data, _), _ in bin_)
            assert size == capacity or size < capacity and size & (size - 1) == 0
            for (doc, start, data, n), _ in bin_:
                assert n == sizes[doc] and np.frombuffer(data, "<u4").tolist() == list(range(start, start + len(data) // 4))
                got[doc] += range(start, start + len(data) // 4)
        assert {doc: sorted(ids) for doc, ids in got.items()} == {doc: list(range(n)) for doc, n in enumerate(sizes)}


# Operator 4


def test_counts_follow_edits():
    counts, rng = pretoken_counts(BYTE_BPE), random.Random(2)
    alphabet = " \n  abcThe'sllve01.,é\t字"
    for n in range(300):
        document = CountedDocument("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, 40, 900]))), counts)
        for _ in range(6):
            start = rng.randint(0, len(document.text))
            document.edit(start, min(len(document.text), start + rng.choice([0, 1, 5, 300])), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 20]))))
        fresh = CountedDocument(document.text, counts)
        assert document.n_tokens == fresh.n_tokens == len(encoder(BYTE_BPE).vocabulary.encode_plain(document.text))
        assert [x for leaf in document.leaves for x in leaf] == [x for leaf in fresh.leaves for x in leaf]


def test_an_edit_touches_few_pretokens():
    document = CountedDocument("some words here. " * 5000, pretoken_counts(BYTE_BPE))
    before = document.encoded
    document.edit(40_000, 40_004, "other")
    assert document.encoded - before < 10


def test_counts_on_edge_rows(spark):
    count = encoder(BYTE_BPE).vocabulary.encode_plain
    want = by_row((i, len(count(t or "")), len(re.findall(r"\w{5,}", t or "")), len(count(re.sub(r"\w{5,}", "#", t or "")))) for i, t, *_ in edge_rows())
    rows = count_tokens(edge_docs(spark), BYTE_BPE, edit_pattern=r"\w{5,}", edit_with="#").collect()
    assert by_row((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in rows) == want
    assert count_tokens(no_docs(spark), BYTE_BPE).count() == 0


def test_counts_with_edits_from_a_column(spark):
    docs = spark.createDataFrame([(1, "one two three", [(4, 7, "2"), (0, 3, "")]), (2, "x", None)], "doc_id long, text string, e array<struct<start: int, end: int, replacement: string>>")
    rows = {r.doc_id: r for r in count_tokens(docs, BYTE_BPE, edits_col="e").collect()}
    assert rows[1].n_tokens_edited == len(encoder(BYTE_BPE).encode(" 2 three")) and rows[1].n_edits == 2 and rows[2].n_edits == 0


# Operator 1


def brute_base(text):
    kinds = [r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    spans = []
    for k, (name, pattern) in enumerate(zip(("assign", "access", "hex"), kinds)):
        for m in re.finditer(pattern, text):
            if len(m.group(2 if k == 0 else 0)) >= (6, 20, 24)[k]:
                spans.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


def test_base_patterns_by_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "Kappa", "=", ":", " ", '"', "'", "abc", "a1b2c3d4e5f6", "AKIA", "ABCD1234EFGH5678", "deadbeef", "x", "\n", "é", "token=abc", "=="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        base, spans = secrets.all_spans(text)
        named = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert named == brute_base(text)
        assert set(base) <= set(spans)
    rows = scan_secrets(edge_docs(spark)).collect()
    want = by_row((i, hashlib.sha256(",".join(brute_base(t or "")).encode()).hexdigest()) for i, t, *_ in edge_rows())
    assert by_row((r.doc_id, r.base_sha256) for r in rows) == want
    assert scan_secrets(no_docs(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('k = "Xy9$kLmn0pQ2rS8t"\nmy_credential = k\n', ["Xy9$kLmn0pQ2rS8t"]),
        ('setPassword("hunter2-Ab9zz")', ["hunter2-Ab9zz"]),
        ("db.pwd: s3cr3tPazz9", ["s3cr3tPazz9"]),
        ('signingKey := "Ab12" + "Cd34Ef56"', ["Ab12", "Cd34Ef56"]),
        ('a = "Zq81" + "Lm22xx"\nprivate_key = a + "Tt7"', ["Zq81", "Lm22xx", "Tt7"]),
        ("auth_key: ${SECRET_FROM_ENV}", []),
        ('credential_name = "database-user-1"', []),
        ("Note: it was the best of times", []),
        ('title = "Xy9$kLmn0pQ2rS8t"', []),
    ],
)
def test_lexing_follows_assignments(text, found):
    assert [text[a:b] for a, _, b in secrets.lexed_spans(text)] == found


def test_redaction(spark):
    docs = spark.createDataFrame([(1, 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" é', 9, "x"), (2, None, None, "y"), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, spans string")
    rows = {r.doc_id: r for r in secrets.redact_documents(docs).collect()}
    assert "2321bac4" not in rows[1].text and rows[1].text.endswith(" é") and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "clean" and rows[3].n_chars == 5
    assert secrets.redact_documents(edge_docs(spark)).schema == edge_docs(spark).schema


# Operator 6


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(line in lines[:n] for n, line in enumerate(lines)), len(covered), failed


def test_base_counts_by_brute_force(spark):
    rng = random.Random(6)
    for _ in range(800):
        text = "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\x0b", "\x85", "\xa0", "#", "é"]) for _ in range(rng.randint(0, 80)))
        assert line_rules.judge(text)[:6] == brute_rules(text)
    rows = clean_documents(edge_docs(spark)).collect()
    assert by_row(tuple(r)[:7] for r in rows) == by_row((i, *brute_rules(t or "")) for i, t, *_ in edge_rows())
    assert not any(r.kept and r.base_failed for r in rows)
    assert clean_documents(no_docs(spark)).count() == 0


def test_lines_are_judged_one_by_one():
    prose = "It was a bright cold day in April, and the clocks were striking thirteen.\n" * 1 + "Winston slipped quickly through the glass doors, though not quickly enough.\n"
    assert line_rules.judge(prose)[6]
    menu = "Home | About | News | Contact | Login\n"
    assert line_rules.judge(menu + prose)[6] and menu.strip() not in line_rules.judge(menu + prose)[7]
    assert "Click here" not in line_rules.judge(prose + "Click here to go on")[7]
    assert not line_rules.judge("BUY!! NOW!! THIS!! IS!! THE!! BEST!! OFFER!! OF!! ALL!! TIME!! EVER!!\n" * 3)[6]
    assert not line_rules.judge(" ".join(f"w{n}$$$" for n in range(60)))[6]


def test_kept_documents_keep_their_columns(spark):
    docs = edge_docs(spark)
    kept = line_rules.keep_documents(docs)
    assert kept.schema == docs.schema
    want = by_row(i for i, t, *_ in edge_rows() if line_rules.judge(t or "")[6])
    assert by_row(r.doc_id for r in kept.collect()) == want


def test_edits_that_cannot_be_made(spark):
    edits = [(0, 1, "x"), (0, 1, "y"), (None, 3, "z"), (2, None, "z"), (-1, 2, "z"), (4, 3, "z"), (3, 99, "z"), (5, 9, None), (8, 10, "late"), (9, 9, "in")]
    docs = spark.createDataFrame([(1, "some words here", edits), (2, None, [(0, 0, "new word")]), (3, "a", [None])], "doc_id long, text string, edits array<struct<start: int, end: int, replacement: string>>")
    rows = {r.doc_id: r for r in count_tokens(docs, BYTE_BPE, edits_col="edits").collect()}
    library = Tokenizer.from_file(BYTE_BPE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert (rows[1].n_edits, rows[1].n_tokens_edited) == (3, count("xome ins here"))
    assert (rows[2].n_edits, rows[2].n_tokens_edited) == (1, count("new word")) and rows[3].n_edits == 0


def test_leaf_split_keeps_counts():
    document = CountedDocument("a b c", pretoken_counts(BYTE_BPE))
    document.edit(5, 5, " word" * (2 * token_counts.LEAF_MOST))
    assert document.n_tokens == CountedDocument(document.text, document.counts).n_tokens
    assert xxhash.xxh64_intdigest(document.text, 0) == xxhash.xxh64_intdigest("a b c" + " word" * (2 * token_counts.LEAF_MOST), 0)
