"""Operator 2: harmonic packing of tokenised documents into fixed-length training sequences.

Lengths are divided into classes by the reciprocals of the capacity: 1, 1/2, 1/3, 1/4, ...  A bin of class ``k`` holds
exactly ``k`` pieces, so a class fills its bins without knowing of any other class or worker.  Since documents may be
cut, a piece is cut to the place that it goes to, a k-th of the capacity, and the rest of the document goes to a later
class; so bins have no gaps, and there are few pieces since what is left shrinks with the square.  Every task packs its
own partition as it streams through it: it holds fewer than ``k`` open pieces of each class, and there is no shuffle.
What is open at the end of a partition is laid out in whole sequences again; the one rest is divided into sequences
whose lengths are powers of two.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from fathom.llm.batches import map_batches, vocabulary_file

#: Entries of the word cache of a Python worker, and the longest word kept in it.
CACHE_ENTRIES, CACHE_KEY_CHARS = 1_000_000, 64


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, with a bounded cache of white-space separated words.

    For a tokenizer that drops white space and never joins words across it.  Texts with characters outside
    the plain range (where normalisation of neighbours, or what counts as white space, could matter) and
    texts that spell out a special token are encoded whole by the library.
    """

    #: Latin letters, digits and punctuation, space, tab and line ends: no combining marks, no other spaces.
    _plain = re.compile("[\t\n\r\\x20-\\x7e\\xa1-\\xac\\xae-ſ]*")

    _closed = re.compile(r"([^\W\d_]+)([.,;:!?]+)")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(vocabulary_file(path))
        self.library.no_truncation()
        self.library.no_padding()
        special = sorted(self.library.get_added_tokens_decoder().items())
        self.special = [t.content for _, t in special]
        self.separator_id, self.separator = special[0][0], special[0][1].content
        self.cache: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian uint32 ids of each text."""
        plain = [self._plain.fullmatch(t) is not None and not ("<|" in t and any(s in t for s in self.special)) for t in texts]
        # the library lowers case letter by letter too, and in this range Python does the same
        words = [t.lower().split() if ok else [] for t, ok in zip(texts, plain)]
        cache = self.cache
        missing = list(set().union(*words).difference(cache))
        if len(cache) + len(missing) > CACHE_ENTRIES:
            cache.clear()
            missing = list(set().union(*words))
        # no pre-token goes on from letters into the punctuation at a word's end
        halves = {w: m.groups() for w in missing if (m := self._closed.fullmatch(w))}
        fresh = list({p for w in missing for p in halves.get(w, (w,))}.difference(cache))
        cache.update(zip(fresh, self._encode_words(fresh)))
        cache.update((w, cache[a] + cache[b]) for w, (a, b) in halves.items())
        out = [b"".join(map(cache.__getitem__, ws)) if ok else self._whole(t) for ws, ok, t in zip(words, plain, texts)]
        for w in {*missing, *fresh}:
            if len(w) > CACHE_KEY_CHARS:
                del cache[w]
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """One call of the library: a special token between two words separates their ids."""
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast([self.separator.join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.separator_id).tolist() + [len(ids)]
        data, at, out = ids.tobytes(), 0, []
        for end in ends:
            out.append(data[4 * at : 4 * end])
            at = end + 1
        assert len(out) == len(words)
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class HarmonicPacker:
    """Open bins of one worker, for documents of packed 4-byte ids.

    Class ``k`` is for what is at least a k-th of the capacity long and shorter than the class before.  Its bins have
    ``k`` places, which divide the capacity as evenly as whole numbers do, and a document is cut to the next free one; what
    is left of it belongs to a later class, and so on.  ``add`` and ``finish`` yield
    ``(sequence number, [((key, start, ids, document's length), offset), ...])``.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list] = {}
        self.sequences = 0

    def _close(self, filled: list):
        self.sequences += 1
        return self.sequences - 1, filled

    def add(self, key, data: bytes):
        n, at, capacity = len(data) // 4, 0, self.capacity
        while at < n:
            k = -(-capacity // (n - at))
            bin_ = self.open.setdefault(k, [])
            offset = capacity * len(bin_) // k
            length = capacity * (len(bin_) + 1) // k - offset
            bin_.append(((key, at, data[4 * at : 4 * (at + length)], n), offset))
            at += length
            if len(bin_) == k:
                yield self._close(self.open.pop(k))

    def finish(self):
        """The open bins' pieces one after the other: whole sequences, then the powers of two that the rest adds up to."""
        left = sum(len(piece[2]) for bin_ in self.open.values() for piece, _ in bin_) // 4
        filled, size, room = [], 0, self._room(left)
        for _, bin_ in sorted(self.open.items()):
            for (key, start, data, n), _ in bin_:
                while data:
                    now, data = data[: 4 * (room - size)], data[4 * (room - size) :]
                    filled.append(((key, start, now, n), size))
                    start, size = start + len(now) // 4, size + len(now) // 4
                    if size == room:
                        yield self._close(filled)
                        left -= room
                        filled, size, room = [], 0, self._room(left)
        self.open = {}

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    Every document's ids end with ``end_id``; a null or empty text is that id alone.  Rows with the same id are
    packed as documents of their own; a null id stays null.  An empty table gives no rows.  Sequence ids are
    unique over the whole result: the partition's number in the upper bits, the worker's count in the lower 40.
    A lost task is packed again from its own partition and gives the same rows.  ``capacity`` is any number from 1 on.
    """
    if capacity < 1:
        raise ValueError(f"a sequence of {capacity} ids can't be filled")

    def task(parts):
        tokenizer, packer = word_tokenizer(vocabulary), HarmonicPacker(capacity)
        first = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()

        def rows(filled):
            for number, pieces in filled:
                for (key, start, data, total), offset in pieces:
                    n = len(data) // 4
                    yield (key, start, n, crc32(data), total, first + number, offset, *([np.frombuffer(data, dtype="<u4").astype("<i4")] if with_ids else []))

        def sent(out):
            return [list(column) for column in zip(*out)]

        for keys, texts in parts:
            out = []
            for key, data in zip(keys, tokenizer.batch([t or "" for t in texts])):
                out += rows(packer.add(key, data + end))
            if out:
                yield sent(out)
        out = list(rows(packer.finish()))
        if out:
            yield sent(out)

    ddl = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return map_batches(docs, [id_col, text_col], ddl, task)
