"""Operator 7: encode whole texts to byte-level BPE ids and decode them again."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from fathom.llm.batches import map_batches
from fathom.llm.bpe import encoder


#: Ids whose decimal forms are joined at once.
DIGEST_IDS = 1 << 16


def ids_digest(ids: np.ndarray, decimal: list[str]) -> str:
    """SHA-256 of decimal ids joined by commas."""
    digest = sha256()
    for at in range(0, len(ids), DIGEST_IDS):
        digest.update(("," * (at > 0) + ",".join(map(decimal.__getitem__, ids[at : at + DIGEST_IDS].tolist()))).encode())
    return digest.hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every document.

    A null text counts as empty: no ids, and an empty decoded text.  Repeated rows each give a row; an id may
    be null.  Special tokens of the vocabulary that are spelled out in a text become their ids, as in the
    published library.
    """

    def task(parts):
        codec = encoder(vocabulary)
        for keys, texts in parts:
            packed = [np.frombuffer(codec.packed(text or ""), dtype="<i4") for text in texts]
            decoded = codec.vocabulary.decode_batch(np.concatenate(packed), np.array([len(p) for p in packed]))
            yield [keys, packed, [d.decode("utf-8", "replace") for d in decoded]]

    return map_batches(docs, [id_col, text_col], f"{id_col} long, ids array<int>, decoded string", task, rows=128)


def codec_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, and SHA-256 of the ids and of the text decoded from them, of every document.

    Rows are those of :func:`encode_documents`; only the digests leave the Python worker.
    """

    def task(parts):
        codec = encoder(vocabulary)
        decimal = [str(i) for i in range(len(codec.vocabulary.tokens))]
        for keys, texts in parts:
            packed = [np.frombuffer(codec.packed(text or ""), dtype="<i4") for text in texts]
            decoded = codec.vocabulary.decode_batch(np.concatenate(packed), np.array([len(p) for p in packed]))
            yield [
                keys,
                [len(ids) for ids in packed],
                [ids_digest(ids, decimal) for ids in packed],
                # bytes that aren't UTF-8 decode to replacement characters, as in the published library
                [sha256(data.decode("utf-8", "replace").encode()).hexdigest() for data in decoded],
            ]

    return map_batches(docs, [id_col, text_col], f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", task, rows=128)
