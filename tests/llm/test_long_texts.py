"""Texts of a megabyte: words, one line, one run of letters, and many empty lines, through every operator on texts."""

import hashlib
import time

import pytest
from tokenizers import Tokenizer

from fathom.llm import byte_cnn, language, near_copies, queries, simhash
from fathom.llm.batches import vocabulary_file
from fathom.llm.codec import codec_digests
from fathom.llm.line_rules import clean_documents
from fathom.llm.packing import pack_documents
from fathom.llm.token_counts import count_tokens
from tests.llm.test_groups import brute_fingerprint

SIZE = 1_000_000
TEXTS = [
    "The quick brown fox jumps over the lazy dog, and 12 others. " * (SIZE // 60),
    "".join(f"line {n} has some words of its own.\n" for n in range(SIZE // 36)),
    "\n" * SIZE,
    "ab" * (SIZE // 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(len(TEXTS))


@pytest.fixture(autouse=True)
def timed():
    began = time.monotonic()
    yield
    assert time.monotonic() - began < 90


def test_packing(docs):
    library = Tokenizer.from_file(vocabulary_file(queries.WORD_BPE))
    rows = pack_documents(docs, queries.WORD_BPE, with_ids=False).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id: r["sum(length)"] for r in rows} == {n: len(library.encode(t, add_special_tokens=False).ids) + 1 for n, t in enumerate(TEXTS)}


def test_codec_and_counts(docs):
    library = Tokenizer.from_file(vocabulary_file(queries.BYTE_BPE))
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    rows = {r.doc_id: r for r in codec_digests(docs, queries.BYTE_BPE).collect()}
    assert [rows[n].n_tokens for n in range(len(TEXTS))] == want
    assert [rows[n].decoded_sha256 for n in range(len(TEXTS))] == [hashlib.sha256(t.encode()).hexdigest() for t in TEXTS]
    counted = {r.doc_id: r for r in count_tokens(docs, queries.BYTE_BPE, edit_pattern=r"lazy dog, and 12 others\. The q", edit_with="x").collect()}
    assert [counted[n].n_tokens for n in range(len(TEXTS))] == want


def test_fingerprints_and_copies(docs):
    rows = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert rows[1] == f"{brute_fingerprint(TEXTS[1]):016x}" and rows[2] == "0" * 16
    assert near_copies.keep_representatives(docs.unionByName(docs)).count() == len(TEXTS)


def test_lines(docs):
    rows = {r.doc_id: r for r in clean_documents(docs).collect()}
    assert [rows[n].n_words for n in range(len(TEXTS))] == [len(t.split()) for t in TEXTS]
    assert rows[0].base_failed and rows[1].base_failed and not rows[2].kept and rows[3].n_words == 1


def test_models(docs):
    net = byte_cnn.ByteNetwork()
    rows = {r.doc_id: r.score for r in byte_cnn.score_quality(docs, net.dumps()).collect()}
    assert [rows[n] for n in range(len(TEXTS))] == pytest.approx([net.score(t) for t in TEXTS])
    sample = docs.selectExpr("explode(sequence(1, 20)) as doc_id", "substring(text, 1, 300) as text", "if(doc_id = 1, 'en', 'xx') as lang")
    model = language.fit(sample, queries.PIECE_BPE)
    found = {r.doc_id: r.lang_pred for r in language.identify_languages(docs, model, queries.PIECE_BPE).collect()}
    assert set(found) == set(range(len(TEXTS))) and found[1] == "en" and found[2] == "und"
