"""Operator 10: language by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary.  A language gives every piece a probability; the probability of a
word is the sum, over all ways to cut it into pieces, of the products of their probabilities, which the forward
algorithm computes in one pass.  The pieces' probabilities are fitted by expectation maximisation, so segmentations
are never chosen, in fitting or in scoring.  Words are runs of letters in lower case; a text's languages are compared
by the sums of their words' log probabilities.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.batches import map_batches, vocabulary_file
from fathom.llm.byte_cnn import fold, in_fold

START = "▁"
WORDS = re.compile(r"[^\W\d_]+")
#: Bounds of the sample that pieces are fitted on: languages (those with the most texts), texts of each language (chosen by
#: a hash of id and text, a repeated row counting once), characters of a text, and characters of all texts of a language.
MOST_LANGUAGES, SAMPLE_PER_LANGUAGE, SAMPLE_TEXT_CHARS, SAMPLE_CHARS = 256, 600, 20_000, 3_000_000
ROUNDS, SMOOTHING, SEED = 4, 0.05, 11
#: Log probability of a character that no piece covers.
UNKNOWN = -18.0
#: Words that a worker keeps, and the longest of these.
CACHE_WORDS, CACHE_WORD_CHARS = 500_000, 48
#: Words that go through the forward algorithm together, and nodes of a batch with longer words.
BATCH_WORDS, BATCH_NODES = 20_000, 1 << 18
#: Steps after which probabilities are scaled anew, so that words of any length stay within doubles.
STRETCH = 32


class Pieces:
    """Pieces of a sentencepiece vocabulary with letters in them, and where they match."""

    def __init__(self, path: str):
        processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(path))
        spelled = {}
        for i in range(processor.get_piece_size()):
            if processor.is_unknown(i) or processor.is_control(i) or processor.is_byte(i):
                continue
            piece = processor.id_to_piece(i).lower()
            if piece.lstrip(START).isalpha() or piece == START:
                spelled.setdefault(piece, len(spelled))
        self.size = len(spelled)
        self.longest = max(map(len, spelled), default=1)
        self.automaton = ahocorasick.Automaton()
        for piece, n in spelled.items():
            self.automaton.add_word(piece, n * 256 + len(piece))
        self.automaton.make_automaton()

    def lattice(self, words: list[str]):
        """Arcs (from node, to node, piece) over all words, by end, and each word's first and last node."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        stops = np.cumsum(lengths)
        found = np.fromiter(chain.from_iterable(self.automaton.iter("".join([f"{START}{w}\n" for w in words]))), dtype=np.int64)
        to, coded = found[::2] + 1, found[1::2]
        return to - coded % 256, to, coded // 256, stops - lengths, stops - 1

    def forward(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), probability.shape[1]))
        for rows in batches_of(words):
            out[rows] = self.run([words[i] for i in rows], probability)
        return out

    def run(self, words: list[str], probability: np.ndarray, expect: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
        """Forward pass over a batch of words of any length; log probabilities.

        With ``weights (words, languages)``, a backward pass adds to ``expect (pieces, languages)``.  A character can
        always be taken as unknown, so every word has a segmentation.  The nodes of every ``STRETCH`` characters of a word
        have a scale of their own, by which what comes from the stretch before is changed.
        """
        source, to, piece, first, last = self.lattice(words)
        size = int(last[-1]) + 1
        word = np.repeat(np.arange(len(words)), last - first + 1)
        depth = np.arange(size) - first[word]
        order = np.argsort(depth[to], kind="stable")
        source, to, piece = source[order], to[order], piece[order]
        by_depth = np.argsort(depth, kind="stable")
        longest = int(depth.max())
        nodes_at = np.searchsorted(depth[by_depth], np.arange(longest + 2))
        arcs_at = np.searchsorted(depth[to], np.arange(longest + 2))
        unknown = np.exp(UNKNOWN)
        alpha = np.zeros((size, probability.shape[1]))
        alpha[first] = 1.0
        scales = [np.zeros((len(words), probability.shape[1]))]  # logarithms, by stretch
        for d in range(1, longest + 1):
            nodes = by_depth[nodes_at[d] : nodes_at[d + 1]]
            arcs = slice(arcs_at[d], arcs_at[d + 1])
            before, into = alpha[nodes - 1], alpha[source[arcs]] * probability[piece[arcs]]
            if d % STRETCH == 0:
                # the node before is reached by every segmentation into unknowns, so it is never zero
                scales.append(scales[-1].copy())
                scales[-1][word[nodes]] += np.log(before)
            if d >= STRETCH and d % STRETCH <= self.longest:
                into *= self._factor(scales, word[to[arcs]], depth[source[arcs]], d)
                if d % STRETCH == 0:
                    before = np.ones_like(before)
            alpha[nodes] = before * unknown
            _add_groups(alpha, to[arcs], into)
        logs = np.log(alpha[last])
        ends = depth[last] // STRETCH
        total = logs + np.stack([scales[e][i] for i, e in enumerate(ends.tolist())]) if longest >= STRETCH else logs
        if expect is not None:
            order = np.lexsort((source, depth[source]))
            source, to, piece = source[order], to[order], piece[order]
            arcs_at = np.searchsorted(depth[source], np.arange(longest + 2))
            # sums over the ends of words divided by the words' probabilities, and scaled like alpha
            beta = np.zeros_like(alpha)
            beta[last] = 1 / alpha[last]
            for d in range(longest - 1, -1, -1):
                nodes = by_depth[nodes_at[d] : nodes_at[d + 1]]
                nodes = nodes[nodes < last[word[nodes]]]
                arcs = slice(arcs_at[d], arcs_at[d + 1])
                after, into = beta[nodes + 1] * unknown, beta[to[arcs]] * probability[piece[arcs]]
                if longest >= STRETCH:
                    far = depth[to[arcs]] // STRETCH > d // STRETCH
                    if far.any():
                        into[far] *= self._factor(scales, word[to[arcs]][far], d, depth[to[arcs]][far])
                    if (d + 1) % STRETCH == 0:
                        after *= self._factor(scales, word[nodes], d, d + 1)
                beta[nodes] = after
                _add_groups(beta, source[arcs], into)
                np.add.at(expect, piece[arcs], alpha[source[arcs]] * into * weights[word[source[arcs]]])
        return total

    @staticmethod
    def _factor(scales: list[np.ndarray], word: np.ndarray, source, to) -> np.ndarray:
        """What takes values from the scale at one depth of a word to that of another, not lesser one."""
        a, b = np.broadcast_to(source, word.shape) // STRETCH, np.broadcast_to(to, word.shape) // STRETCH
        if not len(word):
            return np.ones((0, scales[0].shape[1]))
        low, high = int(a.min()), int(b.max())
        tables = np.stack(scales[low : high + 1])
        return np.exp(tables[a - low, word] - tables[b - low, word])


def batches_of(words: list[str]) -> list[list[int]]:
    """Numbers of the words that go through together: those shorter than a stretch, then longer ones by length."""
    short = [i for i, w in enumerate(words) if len(w) + 1 < STRETCH]
    out = [short[at : at + BATCH_WORDS] for at in range(0, len(short), BATCH_WORDS)]
    nodes = BATCH_NODES
    for i in sorted((i for i, w in enumerate(words) if len(w) + 1 >= STRETCH), key=lambda i: len(words[i])):
        nodes += len(words[i]) + 2
        if nodes > BATCH_NODES:
            out.append([])
            nodes = len(words[i]) + 2
        out[-1].append(i)
    return out


def _add_groups(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add rows of values to the rows ``at`` (in order, with repeats) of a table."""
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        total[at[starts]] += np.add.reduceat(values, starts, axis=0)


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case.  (The pattern also takes number signs such as halves; these go.)"""
    words = WORDS.findall(text.lower())
    return words if all(map(str.isalpha, words)) else [w for w in words if w.isalpha()] + [c for w in words if not w.isalpha() for c in w if c.isalpha()]


def sample(docs: DataFrame, languages: int = MOST_LANGUAGES, per_language: int = SAMPLE_PER_LANGUAGE, text_chars: int = SAMPLE_TEXT_CHARS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """Languages, and ``(lang, text)`` of so many texts of each outside fold 0, in the order of a hash up to the bounds.

    About half as many again are picked by their hash, each once however often its row is repeated; the bounds hold exactly.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (in_fold(id_col) != 0))
    known = known.select(F.xxhash64(id_col, text_col, F.lit(SEED)).alias("h"), F.substring(text_col, 1, text_chars).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return [], known.select("lang", "text").where("false")
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 1.5 * per_language / max(n, 1))])[F.col("lang")]
    picked = known.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h")
    placed = picked.withColumns({"place": F.row_number().over(order), "so_far": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return sorted(sizes), placed.where((F.col("place") <= per_language) & (F.col("so_far") <= max(chars, text_chars))).select("lang", "text")


def fit(docs: DataFrame, vocabulary: str, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """Languages and probabilities of pieces, from a :func:`sample` of at most ``per_language`` documents of each.

    Words are counted on the cluster; only the counts of the sampled documents' words come to the driver, of which the
    sample's bounds are bounds as well.
    """
    languages, chosen = sample(docs, per_language=per_language, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not languages:
        np.savez(out := io.BytesIO(), probability=np.zeros((0, 0)), languages=np.array([], dtype=str))
        return out.getvalue()

    def task(parts):
        for texts, langs in parts:
            counts = Counter((lang, w) for t, lang in zip(texts, langs) for w in words_of(t))
            yield [[k for k, _ in counts], [w for _, w in counts], list(counts.values())]

    counts = map_batches(chosen, ["text", "lang"], "lang string, word string, n long", task).groupBy("word").pivot("lang", languages).agg(F.sum("n")).na.fill(0).toArrow()
    words = counts["word"].to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    weights = np.stack([counts[c].to_numpy() for c in counts.column_names[1:]], 1)[order].astype(np.float64)
    np.savez(out := io.BytesIO(), probability=expectation_maximisation(pieces_of(vocabulary), words, weights).astype(np.float32), languages=np.array(languages))
    return out.getvalue()


def expectation_maximisation(pieces: Pieces, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Probabilities (pieces, languages) from counts (words, languages)."""
    n = weights.shape[1]
    probability, batches = np.full((pieces.size, n), 1 / pieces.size), batches_of(words)
    for _ in range(ROUNDS):
        expect = np.zeros_like(probability)
        for rows in batches:
            pieces.run([words[i] for i in rows], probability, expect, weights[rows])
        expect += SMOOTHING
        probability = expect / expect.sum(axis=0)
    return probability


class Identifier:
    """Scores texts in one worker; log probabilities of frequent words are kept."""

    def __init__(self, model: bytes, vocabulary: str):
        data = np.load(io.BytesIO(model))
        self.probability, self.languages = data["probability"].astype(np.float64), [str(x) for x in data["languages"]]
        self.pieces = pieces_of(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        words = [words_of(t) if t else [] for t in texts]
        rows = self.rows
        new = list(set().union(*words).difference(rows)) if words else []
        if len(rows) + len(new) > CACHE_WORDS:
            self._clear()
            rows = self.rows
            new = list(set().union(*words))
        long = [w for w in new if len(w) > CACHE_WORD_CHARS]
        base = len(self.scores)
        rows.update(zip(new, range(base, base + len(new))))
        self.scores = np.concatenate([self.scores, self.pieces.forward(new, self.probability)]) if new else self.scores
        out = []
        for ws in words:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = self.scores[list(map(rows.__getitem__, ws))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        for w in long:
            del rows[w]
        return out


_identifiers: dict[tuple[bytes, str], Identifier] = {}


def identify_languages(docs: DataFrame, model: bytes, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` of every document.

    ``score`` is the posterior of the language found, all languages being as likely at first; of equal languages the
    first by name is taken.  A null text and one without a letter give ``und`` with score 0, and so does a model
    fitted on no text.  ``held_out`` says that the id is in fold 0 (a null id isn't).  Repeated rows each give a row.
    """

    def task(parts):
        if (model, vocabulary) not in _identifiers:
            _identifiers.clear()
            _identifiers[model, vocabulary] = Identifier(model, vocabulary)
        identifier = _identifiers[model, vocabulary]
        for keys, texts in parts:
            found = identifier.batch(texts)
            yield [keys, [k is not None and fold(k) == 0 for k in keys], [lang for lang, _ in found], [s for _, s in found]]

    return map_batches(docs, [id_col, text_col], f"{id_col} long, held_out boolean, lang_pred string, score double", task)
