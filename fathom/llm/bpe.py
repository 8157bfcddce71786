"""Exact byte-pair encoding by backtracking over Aho-Corasick matches.

Method
------
Every vocabulary entry is put in one Aho-Corasick automaton, which gives the longest token that starts
at each position of a pre-token in one pass.  The encoder takes that token, and keeps it only if the pair
(previous token, token) is *compatible*: the two would come out as exactly these two tokens if their joined
bytes were merged from scratch.  If not, it tries the next shorter token that is a prefix, and when none is
left it removes the previous token and goes on from there.  Positions found to be dead are marked, so each is
left once and the work is linear in the length.  Compatibility is decided from the two tokens' merge
histories alone and remembered in a table.

Decoding gathers bytes from one blob of all token bytes through an offset table, for a block of ids at once.

Texts are cut at every space that precedes a non-space.  No pre-token of this tokenizer crosses such a place,
so what is encoded between two of them can be kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
from struct import pack

import ahocorasick
import numpy as np
import regex

from fathom.llm.batches import vocabulary_file

#: The split pattern that the byte-level vocabularies are published with.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries that a chunk cache holds at most; it is emptied when full (results don't depend on it).
CACHE_ENTRIES = 600_000
#: Entries that the table of pair compatibility holds at most.
COMPATIBLE_ENTRIES = 500_000
#: Longer chunks are encoded each time they occur, so that the cache stays small.
CACHE_KEY_CHARS = 64

#: Ids that are decoded at once.
DECODE_IDS = 1 << 16

#: Marks that a word ends with, and the end of the letters of which every Unicode version says the same.
CLOSING, PLAIN_LETTERS = frozenset(".,;:!?"), "\u0250"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte, as byte-level vocabularies spell their entries."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class BytePairVocabulary:
    """Byte-level vocabulary: token bytes, merge histories, and the tables for encoding and decoding."""

    def __init__(self, path: str):
        with open(vocabulary_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        spelled = spec["model"]["vocab"]
        size = max(max(spelled.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.tokens: list[bytes] = [b""] * size
        for shown, i in spelled.items():
            self.tokens[i] = bytes(back[c] for c in shown)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        last = -1
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i = spelled[a + b]
            if i <= last:
                raise ValueError(f"{path}: ids don't follow the order of merges")
            last = i
            self.pairs[spelled[a], spelled[b]] = i
            self.halves[i] = (spelled[a], spelled[b])
        self.automaton = ahocorasick.Automaton()
        self.by_bytes: dict[bytes, int] = {}
        for i in spelled.values():
            token = self.tokens[i]
            self.by_bytes[token] = i
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.split = regex.compile(SPLIT_PATTERN)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.sizes = [len(t) for t in self.tokens]
        lengths = np.array(self.sizes, dtype=np.int64)
        self.lengths = lengths
        self.stable: set[int] = set()
        self.stable = {i for i in self.by_bytes.values() if self.encode_bytes(self.tokens[i]) == [i]}
        self.offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def next_shorter(self, token: int) -> int:
        """Longest token that is a proper prefix of this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            data, found = self.tokens[token], -1
            for n in range(len(data) - 1, 0, -1):
                if (found := self.by_bytes.get(data[:n], -1)) >= 0:
                    break
            self.shorter[token] = found
        return found

    def is_compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens from scratch ends in these two tokens."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > COMPATIBLE_ENTRIES:
                self.compatible.clear()
            known = self.compatible[key] = self._untangle(left, right)
        return known

    def _untangle(self, a: int, b: int) -> bool:
        """Undo merges at the seam, latest first; a merge across it that came earlier than both is a conflict."""
        before = len(self.tokens)
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < before:
                return False
            if a > b:
                before = a
                if a not in self.halves:
                    return True
                a = self.halves[a][1]
            else:
                if b not in self.halves:
                    # the seam's right side is a byte; what remains can only come apart on the left
                    before = b + 1
                    while a in self.halves and a >= before:
                        a = self.halves[a][1]
                    if a not in self.halves or a < before:
                        return True
                    continue
                before = b + 1
                b = self.halves[b][0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.by_bytes.get(data)
        if whole is not None and whole in self.stable:
            return [whole]
        size, sizes = len(data), self.sizes
        longest = [-1] * size
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token
        known, out, last = self.compatible.get, [], -1
        alive = bytearray(b"\x01") * (size + 1)
        at, token = 0, longest[0]
        while True:
            while True:
                end = at + sizes[token]
                if alive[end] and (last < 0 or (known(last << 32 | token) or self.is_compatible(last, token))):
                    if end == size:
                        out.append(token)
                        return out
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    break
                shorter = self.next_shorter(token)
                if shorter >= 0:
                    token = shorter
                    continue
                alive[at] = 0
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                break

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which no special token is looked for."""
        ids: list[int] = []
        for piece in self.split.findall(text):
            ids += self.encode_bytes(piece.encode())
        return ids

    def _spelled(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        spread = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        spread += np.arange(len(spread), dtype=np.int64)
        return self.blob[spread].tobytes()

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each document, from all ids of a batch and the number of ids of each document.

        Ids are looked up in blocks, so that the places of single bytes, eight bytes each, are never many at once.
        """
        data = b"".join([self._spelled(ids[at : at + DECODE_IDS]) for at in range(0, len(ids), DECODE_IDS)])
        starts = np.concatenate([[0], np.cumsum(counts)])
        sizes = [int(self.lengths[ids[a:b]].sum()) for a, b in zip(starts.tolist(), starts[1:].tolist())]
        stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()
        return [data[a:b] for a, b in zip(stops, stops[1:])]


def packed_ids(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}i", *ids)


class ChunkCache(dict):
    """Chunk of text -> its ids as packed little-endian int32, filled on first use, bounded in entries and key length."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        value = self.encode(chunk)
        if len(chunk) <= CACHE_KEY_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = value
        return value


class TextEncoder:
    """Whole texts to ids, as the published library does it with default settings and no added tokens."""

    #: A space before white space: then the cuts at spaces alone aren't safe.
    _odd = re.compile(r" \s|^ | $")
    _cut = regex.compile(r"(?= \S)")

    def __init__(self, vocabulary: BytePairVocabulary):
        self.vocabulary = vocabulary
        self.cache = ChunkCache(lambda chunk: packed_ids(vocabulary.encode_plain(chunk)))
        self.spaced = ChunkCache(self._spaced)

    def _spaced(self, chunk: str) -> bytes:
        """Ids of a chunk behind a space.

        Plain letters are one pre-token with the space, and a mark at their end is one of its own, so words that differ
        by that mark only are encoded once.
        """
        word = chunk[:-1] if chunk[-1:] in CLOSING else chunk
        if word.isalpha() and (word.isascii() or max(word) < PLAIN_LETTERS):
            if word is not chunk:
                return self.spaced[word] + self.cache[chunk[-1]]
            return packed_ids(self.vocabulary.encode_bytes(b" " + word.encode()))
        return packed_ids(self.vocabulary.encode_plain(" " + chunk))

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian int32."""
        if not text:
            return b""
        special = self.vocabulary.special_split
        if special is not None and any(s in text for s in self.vocabulary.special):
            out = []
            for n, part in enumerate(special.split(text)):
                out.append(pack("<i", self.vocabulary.special[part]) if n % 2 else self.packed(part))
            return b"".join(out)
        if self._odd.search(text):
            return b"".join([self.cache[part] for part in self._cut.split(text) if part])
        first, *rest = text.split(" ")
        return self.cache[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(BytePairVocabulary(path))
    return _encoders[path]
