"""Operator 4: token counts that follow edits.

A document is kept as a segment tree over its pre-tokens: every node holds a run of pre-tokens with its text, and the
numbers of characters and tokens of its subtree.  An edit re-splits only from shortly before the edited place until the
new pre-tokens fall in step with the old ones again, encodes only those, and updates the sums on the paths above.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from fathom.llm.batches import map_batches
from fathom.llm.bpe import CACHE_KEY_CHARS, BytePairVocabulary, encoder

#: Pre-tokens of a leaf when the tree is built, and how many make it split.
LEAF, LEAF_MOST = 64, 256
#: Characters behind a pre-token's end that the split pattern may have looked at.
LOOKAHEAD = 2
#: Entries of the table of counts by pre-token of a Python worker.
COUNT_ENTRIES = 600_000


class PretokenCounts(dict):
    """Pre-token -> number of tokens, filled on first use and bounded."""

    def __init__(self, vocabulary: BytePairVocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        n = len(self.vocabulary.encode_bytes(piece.encode()))
        if len(piece) <= CACHE_KEY_CHARS:
            if len(self) >= COUNT_ENTRIES:
                self.clear()
            self[piece] = n
        return n


class Leaf:
    """A node of the tree: a run of pre-tokens with its own text, and the sums of its subtree."""

    __slots__ = ("text", "pieces", "own_tokens", "left", "right", "chars", "tokens", "size")

    def __init__(self, text: str, pieces: list[tuple[int, int]]):
        self.text, self.pieces, self.own_tokens = text, pieces, sum(t for _, t in pieces)
        self.left: Leaf | None = None
        self.right: Leaf | None = None


class CountedDocument:
    """Text with its token count kept up to date under edits.

    Leaves stand in a binary tree in the order of the text.  Trees are cut before a leaf and joined again, where the root is
    taken from either side by chance in proportion to the sizes, so the depth stays logarithmic.  An edit takes out the
    leaves that it touches, without looking at others, and puts their successors in their place.  Special tokens spelled out
    in the text count as ordinary characters.
    """

    def __init__(self, text: str, counts: PretokenCounts):
        self.counts, self.split = counts, counts.vocabulary.split
        self.encoded = self.touched = 0
        self._chance = random.Random(0)
        pieces = self.split.findall(text)
        self.encoded += len(pieces)
        self.root = self._tree(self._leaves(text, [(len(p), self.counts[p]) for p in pieces]))

    def _leaves(self, text: str, pieces: list[tuple[int, int]]) -> list[Leaf]:
        out, at = [], 0
        for n in range(0, len(pieces), LEAF):
            own = pieces[n : n + LEAF]
            end = at + sum(c for c, _ in own)
            out.append(Leaf(text[at:end], own))
            at = end
        return out

    def _tree(self, leaves: list[Leaf]) -> Leaf | None:
        if not leaves:
            return None
        middle = len(leaves) // 2
        leaves[middle].left, leaves[middle].right = self._tree(leaves[:middle]), self._tree(leaves[middle + 1 :])
        return self._sums(leaves[middle])

    def _sums(self, node: Leaf) -> Leaf:
        self.touched += 1
        node.chars, node.tokens, node.size = len(node.text), node.own_tokens, 1
        for child in (node.left, node.right):
            if child is not None:
                node.chars += child.chars
                node.tokens += child.tokens
                node.size += child.size
        return node

    def _join(self, a: Leaf | None, b: Leaf | None) -> Leaf | None:
        if a is None or b is None:
            return a or b
        if self._chance.random() * (a.size + b.size) < a.size:
            a.right = self._join(a.right, b)
            return self._sums(a)
        b.left = self._join(a, b.left)
        return self._sums(b)

    def _cut(self, node: Leaf | None, at: int) -> tuple[Leaf | None, Leaf | None]:
        """The leaves before the one that holds the character ``at``, and the others; the end of the text is in the last."""
        if node is None:
            return None, None
        before = node.left.chars if node.left is not None else 0
        if at < before:
            left, node.left = self._cut(node.left, at)
            return left, self._sums(node)
        if at < before + len(node.text) or node.right is None:
            left, node.left = node.left, None
            return left, self._sums(node)
        node.right, right = self._cut(node.right, at - before - len(node.text))
        return self._sums(node), right

    def _first(self, node: Leaf) -> tuple[Leaf, Leaf | None]:
        """The first leaf, and the tree without it."""
        if node.left is None:
            return node, node.right
        first, node.left = self._first(node.left)
        return first, self._sums(node)

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root is not None else 0

    def __len__(self) -> int:
        return self.root.chars if self.root is not None else 0

    @property
    def leaves(self) -> list[list[tuple[int, int]]]:
        return [leaf.pieces for leaf in self._in_order()]

    @property
    def text(self) -> str:
        return "".join([leaf.text for leaf in self._in_order()])

    def _in_order(self) -> Iterator[Leaf]:
        open_, node = [], self.root
        while open_ or node is not None:
            while node is not None:
                open_.append(node)
                node = node.left
            node = open_.pop()
            yield node
            node = node.right

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` to before ``end``."""
        if not 0 <= start <= end <= len(self):
            raise ValueError(f"edit {start}:{end} is outside the text")
        before, rest = self._cut(self.root, max(0, start - LOOKAHEAD))
        at = before.chars if before is not None else 0
        text, pieces, kept = "", [], 0

        def pull() -> None:
            """Take more leaves: one, and then as much text as there is already, so that none is copied often."""
            nonlocal rest, text
            more = []
            while rest is not None and sum(map(len, more)) <= len(text):
                leaf, rest = self._first(rest)
                more.append(leaf.text)
                pieces.extend(leaf.pieces)
            text += "".join(more)

        while rest is not None and (not pieces or at + len(text) < end):
            pull()
        # pre-tokens that end too far before the edit to have seen it
        low = 0
        while kept < len(pieces) and at + low + pieces[kept][0] + LOOKAHEAD <= start:
            low += pieces[kept][0]
            kept += 1
        text = text[: start - at] + replacement + text[end - at :]
        shift = len(replacement) - (end - start)
        # old starts of pre-tokens at or behind the edit's end, shifted: where the new split may fall in step
        old, new, skip, fresh = low, low, kept, []
        while True:
            while old < end - at or old + shift < new:
                if skip == len(pieces):
                    if rest is None:
                        break
                    pull()
                old += pieces[skip][0]
                skip += 1
            if old >= end - at and old + shift == new:
                break
            match = self.split.match(text, new)
            if match is None or match.end() + LOOKAHEAD > len(text) and rest is not None:
                pull()
                continue
            piece = match.group()
            self.encoded += 1
            fresh.append((len(piece), self.counts[piece]))
            new = match.end()
        merged = pieces[:kept] + fresh + pieces[skip:]
        if len(merged) > LEAF_MOST:
            middle = self._tree(self._leaves(text, merged))
        else:
            middle = self._sums(Leaf(text, merged)) if merged else None
        self.root = self._join(self._join(before, middle), rest)


_counts: dict[str, PretokenCounts] = {}


def pretoken_counts(path: str) -> PretokenCounts:
    if path not in _counts:
        _counts[path] = PretokenCounts(encoder(path).vocabulary)
    return _counts[path]


def apply_edits(document: CountedDocument, edits: list[tuple[int, int, str]]) -> None:
    """Edits given by places in the text before any of them, not overlapping; later places first."""
    for start, end, replacement in reversed(edits):
        document.edit(start, end, replacement)


def sound_edits(edits: Iterable, n_chars: int) -> list[tuple[int, int, str]]:
    """The edits in order of place, without nulls, places outside the text, and what overlaps an edit before it."""
    out: list[tuple[int, int, str]] = []
    given = [(e["start"], e["end"], e["replacement"] or "") for e in edits if e is not None and e["start"] is not None and e["end"] is not None]
    for start, end, replacement in sorted(given):
        if 0 <= start <= end <= n_chars and (not out or start >= out[-1][1] and (start, end) != out[-1][:2]):
            out.append((start, end, replacement))
    return out


def count_tokens(docs: DataFrame, vocabulary: str, edits_col: str | None = None, edit_pattern: str | None = None, edit_with: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_edits, n_tokens_edited, n_encoded)`` of every document.

    ``edits_col`` names a column ``array<struct<start: int, end: int, replacement: string>>`` of edits to the text
    (code points, end exclusive); null means none, and a null replacement an empty one.  Edits with a null place or one
    outside the text, and those that overlap an edit before them or have the same place, are left out.  Instead, ``edit_pattern`` replaces each of its
    matches by ``edit_with``.  ``n_encoded`` is the number of pre-tokens
    split and encoded for the edits.  A null or empty text has 0 tokens.  Repeated rows each give a row.
    """
    columns = [id_col, text_col] + ([edits_col] if edits_col else [])
    if edits_col and edit_pattern:
        raise ValueError("give edits or a pattern, not both")

    def task(parts):
        counts, pattern = pretoken_counts(vocabulary), edit_pattern and re.compile(edit_pattern)
        for keys, texts, *more in parts:
            rows = []
            for key, text, edits in zip(keys, texts, more[0] if more else [None] * len(keys)):
                document = CountedDocument(text or "", counts)
                before, built = document.n_tokens, document.encoded
                if pattern:
                    edits = [(*m.span(), edit_with) for m in pattern.finditer(text or "")]
                else:
                    edits = sound_edits(edits or (), len(text or ""))
                apply_edits(document, edits)
                rows.append((key, before, len(edits), document.n_tokens, document.encoded - built))
            yield [list(c) for c in zip(*rows)]

    return map_batches(docs, columns, f"{id_col} long, n_tokens long, n_edits long, n_tokens_edited long, n_encoded long", task)
