"""Work that grows with a text's length only: edits of a tree, blocks in blocks, slices by bytes, bounded samples."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import batches, bpe, language, queries, secrets
from fathom.llm.bpe import encoder
from fathom.llm.codec import ids_digest
from fathom.llm.token_counts import CountedDocument, apply_edits, pretoken_counts


def numbered(n):
    return "".join(f"call {k % 7} now 555 010 {k:07d} or later. " for k in range(n))


def edits_of(text):
    import re

    return [(*m.span(), "#") for m in re.finditer(queries.LONG_NUMBER, text)]


def edited(text, edits):
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


def test_edits_take_linear_time():
    counts = pretoken_counts(queries.BYTE_BPE)
    CountedDocument(numbered(200), counts)
    touched, seconds = {}, {}
    for n in (2_000, 32_000):
        text = numbered(n)
        edits = edits_of(text)
        assert len(edits) == n
        document = CountedDocument(text, counts)
        built, began = document.touched, time.perf_counter()
        apply_edits(document, edits)
        touched[n], seconds[n] = document.touched - built, time.perf_counter() - began
        assert document.n_tokens == len(encoder(queries.BYTE_BPE).vocabulary.encode_plain(edited(text, edits)))
    assert len(text) > 1_000_000
    assert touched[32_000] < 16 * 2 * touched[2_000] and seconds[32_000] < 16 * 4 * seconds[2_000]


@pytest.mark.parametrize("seed", range(6))
def test_edits_in_any_order(seed):
    rng, counts = random.Random(seed), pretoken_counts(queries.BYTE_BPE)
    alphabet = ["a", "b ", " ", "  ", "\n", "'s", "1", "é", "!", "word"]
    text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 3000])))
    document = CountedDocument(text, counts)
    for _ in range(60):
        start = rng.randint(0, len(text))
        end, new = min(len(text), start + rng.choice([0, 1, 4, 60, 900])), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 4, 700])))
        document.edit(start, end, new)
        text = text[:start] + new + text[end:]
        fresh = CountedDocument(text, counts)
        assert document.text == text and len(document) == len(text) and document.n_tokens == fresh.n_tokens
        assert [x for leaf in document.leaves for x in leaf] == [x for leaf in fresh.leaves for x in leaf]


def test_one_long_piece_is_edited():
    counts = pretoken_counts(queries.BYTE_BPE)
    document = CountedDocument("ab" * 20_000, counts)
    document.edit(20_001, 20_002, " ")
    assert document.n_tokens == CountedDocument("ab" * 10_000 + "a " + "ab" * 9_999, counts).n_tokens


VALUE = "s3cr3T-Xy9Kq27LmP0"


def nested(depth):
    return "".join(f"{' ' * n}key{n}: |\n" for n in range(depth)) + " " * depth + VALUE + "\n"


def test_nested_blocks_take_linear_time():
    seconds = {}
    for depth in (350, 1400):
        text = "".join(nested(depth) for _ in range(2))
        began = time.perf_counter()
        secrets.all_spans(text)
        seconds[depth] = (time.perf_counter() - began) / len(text)
    assert seconds[1400] < 3 * seconds[350]


def test_nested_blocks_hold_their_lines():
    text = f"outer: |\n  plain words\n  db_passphrase: |\n    {VALUE}\n\n    {VALUE}x\n  other: >\n    {VALUE}y\nnext: {VALUE}z\n"
    assert [text[a:b] for a, k, b in secrets.all_spans(text)[1] if k == 3] == [VALUE, VALUE + "x"]
    whole = f"signing_key: |\n  {VALUE}\n  part:|\n    {VALUE}x\n"
    assert [whole[a:b] for a, k, b in secrets.all_spans(whole)[1] if k == 3] == [VALUE, "part:|", VALUE + "x"]


def brute_block(text, key):
    """Stripped lines below the line ``key`` that stand further in, blank ones between them included."""
    lines = text.split("\n")
    indent = lambda t: len(t) - len(t.lstrip())
    out = []
    for line in lines[key + 1 :]:
        if line.strip() and indent(line) <= indent(lines[key]):
            break
        out.append(line.strip())
    return [t for t in out if t]


@pytest.mark.parametrize("seed", range(5))
def test_blocks_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        lines = [" " * rng.randrange(5) + rng.choice(["a: |", "b: >", "c: |2 # x", "text", "", "d: e", "f:"]) for _ in range(rng.randint(1, 25))]
        text = "\n".join(lines) + "\n" * rng.randrange(2)
        blocks, at = secrets.Blocks(text), 0
        for n, line in enumerate(lines):
            if ":" in line:
                found = blocks.below(at + line.index(":"))
                spans = sorted(found.spans({})) if found is not None else []
                assert [text[a:b] for a, b in spans] == brute_block(text, n)
            at += len(line) + 1


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_pydict({"k": list(range(100)), "t": ["x" * (3_000_000 if n % 10 == 0 else 100) for n in range(100)]})
    parts = list(batches.cut(batch))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(100))
    assert all(p.nbytes <= batches.SLICE_BYTES or p.num_rows == 1 for p in parts) and len(parts) < 60
    assert [p.num_rows for p in batches.cut(batch, rows=40, size=1 << 40)] == [40, 40, 20]
    assert list(batches.cut(batch.slice(0, 0))) == []


def test_decoding_in_blocks(monkeypatch):
    vocabulary = encoder(queries.BYTE_BPE).vocabulary
    texts = ["", "some words " * 50, "é😀" * 40, "", "end"]
    ids = [np.array(vocabulary.encode_plain(t), dtype=np.int32) for t in texts]
    decimal = [str(i) for i in range(len(vocabulary.tokens))]
    whole = [ids_digest(i, decimal) for i in ids]
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(bpe, "DECODE_IDS", size)
        monkeypatch.setattr("fathom.llm.codec.DIGEST_IDS", size)
        assert [d.decode() for d in vocabulary.decode_batch(np.concatenate(ids), np.array([len(i) for i in ids]))] == texts
        assert [ids_digest(i, decimal) for i in ids] == whole


def test_sample_is_bounded(spark):
    rows = [(n, f"text number {n} " * 5, f"l{n % 3}") for n in range(3000)] + [(7, "the same row again", "l0")] * 3000 + [(9000 + n, "rare", "rare") for n in range(3)] + [(1, "x" * 900, "l1"), (None, "y", "l1"), (2, None, "l1"), (3, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, chosen = language.sample(docs, languages=3, per_language=100, text_chars=50, chars=4_000)
    found = chosen.collect()
    assert languages == ["l0", "l1", "l2"] and chosen.columns == ["lang", "text"]
    by = {name: [r.text for r in found if r.lang == name] for name in languages}
    assert all(60 <= len(v) <= 100 and sum(map(len, v)) <= 4_000 and max(map(len, v)) <= 50 for v in by.values())
    assert sum(t == "the same row again" for t in by["l0"]) <= 1
    assert sorted(found) == sorted(language.sample(docs.repartition(9), 3, 100, 50, 4_000)[1].collect())
    every = language.sample(docs)[1]
    assert {r.lang for r in every.collect()} <= {"l0", "l1", "l2", "rare"} and language.sample(docs.where("false"))[0] == []
