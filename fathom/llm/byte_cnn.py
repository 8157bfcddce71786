"""Operator 9: text quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved with learned filters.  Each filter's largest response is taken in
every chunk; chunks overlap by half and cover the whole text.  Mean and maximum over chunks go through one
logistic unit.  Embedding and filters are multiplied into one table per filter column, so a response is a sum of
looked-up rows; texts are streamed through in blocks, so memory doesn't depend on their length.
"""

from __future__ import annotations

import io
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.batches import ddl_of, map_batches, quoted

WIDTH, EMBED, FILTERS = 5, 8, 12
#: Positions of half a chunk.
HALF = 128
#: Positions convolved at once.
BLOCK = 1 << 15
#: Documents of each label that the network is fitted on, about (chosen by a hash of the id).
SAMPLE = {0: 1200, 1: 3600}
#: Longest text in that sample; with the number of documents this bounds what the driver holds.  All texts are scored whole.
SAMPLE_CHARS = 20_000
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.02, 7
PASS_SCORE = 0.3


class ByteNetwork:
    """Parameters ``emb (256, E)``, ``conv (W, E, F)``, ``bias (F)``, ``out (2F)`` and ``shift (1)``."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None):
        if parameters is None:
            rng = np.random.default_rng(SEED)
            parameters = {"emb": rng.normal(0, 0.5, (256, EMBED)), "conv": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "shift": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in parameters.items()}
        self._tables()

    def _tables(self) -> None:
        self.table = np.einsum("be,wef->wbf", self.p["emb"], self.p["conv"]).astype(np.float32)

    def dumps(self) -> bytes:
        np.savez(out := io.BytesIO(), **self.p)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> ByteNetwork:
        return cls(dict(np.load(io.BytesIO(data))))

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses at every position that has ``WIDTH`` bytes from it on."""
        n = len(codes) - WIDTH + 1
        out = np.take(self.table[0], codes[:n], axis=0)
        for w in range(1, WIDTH):
            out += np.take(self.table[w], codes[w : w + n], axis=0)
        return out

    def halves(self, text: bytes, where: bool = False):
        """Largest response of each filter in each half chunk, and its position if ``where``."""
        codes = np.frombuffer(text + bytes(WIDTH - 1), dtype=np.uint8).astype(np.intp)
        n = max(1, len(codes) - WIDTH + 1)
        if len(codes) < WIDTH:
            codes = np.zeros(WIDTH, dtype=np.intp)
        most, places = [], []
        for at in range(0, n, BLOCK):
            r = self.responses(codes[at : min(n, at + BLOCK) + WIDTH - 1])
            starts = np.arange(0, len(r), HALF)
            most.append(np.maximum.reduceat(r, starts, axis=0))
            if where:
                short = -len(r) % HALF
                padded = np.concatenate([r, np.full((short, r.shape[1]), -np.inf, dtype=np.float32)]) if short else r
                places.append(padded.reshape(len(starts), HALF, -1).argmax(axis=1) + starts[:, None] + at)
        return np.concatenate(most), (np.concatenate(places) if where else None), codes

    def features(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and maximum over chunks of the rectified chunk maxima, and these."""
        chunks = np.maximum(most[:-1], most[1:]) if len(most) > 1 else most
        chunks = np.maximum(chunks + self.p["bias"], 0)
        return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]), chunks

    def score(self, text: str) -> float:
        """Probability of the label 1; defined for an empty text too."""
        features, _ = self.features(self.halves(text.encode())[0])
        z = float(features @ self.p["out"] + self.p["shift"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    def _gradients(self, text: bytes, label: float, total: dict[str, np.ndarray], table: np.ndarray) -> float:
        most, places, codes = self.halves(text, where=True)
        features, chunks = self.features(most)
        z = float(features @ self.p["out"] + self.p["shift"][0])
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        d = p - label
        total["out"] += d * features
        total["shift"] += d
        n, f = chunks.shape
        by_chunk = np.full(chunks.shape, d / n, dtype=np.float32) * self.p["out"][:f]
        by_chunk[chunks.argmax(axis=0), np.arange(f)] += d * self.p["out"][f:]
        by_chunk *= chunks > 0
        total["bias"] += by_chunk.sum(axis=0)
        place = np.where(most[:-1] >= most[1:], places[:-1], places[1:]) if len(most) > 1 else places
        column = np.broadcast_to(np.arange(f), place.shape)
        for w in range(WIDTH):
            np.add.at(table[w], (codes[place + w], column), by_chunk)
        return -np.log(max(p if label else 1 - p, 1e-9))

    def fit(self, texts: list[str], labels: list[int]) -> ByteNetwork:
        """Adam over whole texts, in an order fixed by ``SEED``."""
        data = [t.encode() for t in texts]
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(data))
            for at in range(0, len(order), BATCH):
                picked = order[at : at + BATCH]
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                table = np.zeros_like(self.table)
                for i in picked:
                    self._gradients(data[i], labels[i], grad, table)
                grad["emb"] = np.einsum("wbf,wef->be", table, self.p["conv"])
                grad["conv"] = np.einsum("be,wbf->wef", self.p["emb"], table)
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in grad.items():
                    g = g / len(picked) + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
                self._tables()
        return self


def fold(doc_id) -> int:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return crc32(str(doc_id).encode()) % 5


def in_fold(id_col):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[str, int]]:
    """Texts and labels of about ``sample[label]`` documents of each label (at most 1.2 times as many), without fold 0.

    Chosen by a hash of the id, so the choice doesn't depend on how the tables are stored.  Labels other than 0 and 1,
    null ids, null texts and texts of over ``SAMPLE_CHARS`` characters are left out.
    """
    sample = sample or SAMPLE
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (in_fold(id_col) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(sample[k] / n)) for k, n in sizes.items()]) if sizes else F.lit(0.0)
    # at most this many rows, the first by a hash, so they can be sent to every task and no text is shuffled
    most = int(1.2 * sum(sample.values()))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < share * 1_000_000)
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id", F.lit(SEED + 1)), "id", "label").limit(most))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(chosen, "id")
    rows = picked.select("id", "text", "label").orderBy(F.xxhash64("id", "text"), "id", "text", "label").limit(most).collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["id"], r["text"], r["label"]))]


def train(docs: DataFrame, labels: DataFrame, **names) -> bytes:
    """Parameters of a network fitted on :func:`labelled_sample`; of an untrained one, with even scores, if it is empty."""
    sample = labelled_sample(docs, labels, **names)
    network = ByteNetwork()
    if not sample:
        network.p["out"][:] = 0
        return network.dumps()
    return network.fit([t for t, _ in sample], [y for _, y in sample]).dumps()


_networks: dict[bytes, ByteNetwork] = {}


def network(parameters: bytes) -> ByteNetwork:
    if parameters not in _networks:
        _networks.clear()
        _networks[parameters] = ByteNetwork.loads(parameters)
    return _networks[parameters]


def score_quality(docs: DataFrame, parameters: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document; a null text is scored as an empty one.

    ``held_out`` says that the id is in fold 0 (a null id isn't).  Repeated rows each give a row.
    """

    def task(parts):
        net = network(parameters)
        for keys, texts in parts:
            scores = [net.score(t or "") for t in texts]
            yield [keys, [k is not None and fold(k) == 0 for k in keys], scores, [int(s >= PASS_SCORE) for s in scores]]

    return map_batches(docs, [id_col, text_col], f"{id_col} long, held_out boolean, score double, predicted int", task)


def keep_quality(docs: DataFrame, parameters: bytes, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, in their own columns.

    A null text is scored as an empty one.  Repeated rows stay or go alike; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def task(parts):
        net = network(parameters)
        for columns in parts:
            keep = [net.score(t or "") >= PASS_SCORE for t in columns[at]]
            if any(keep):
                yield [[v for v, k in zip(column, keep) if k] for column in columns]

    return map_batches(docs, [quoted(c) for c in docs.columns], ddl_of(docs), task)
