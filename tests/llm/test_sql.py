"""The SQL twins on rows that the given tables don't have."""

import random
from collections import Counter

import duckdb
import pyarrow as pa

from fathom.llm import oracles
from fathom.llm.line_rules import clean_documents
from fathom.llm.vectors import near_vectors
from tests.llm.edge import edge_rows


def test_line_rules(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta.", "a", "BUY!!", "x$$$", "|", "home", "click here", "Cookie", "use cookies", "é", "end,", "\t", "»"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(1000 + n, t) for n, (_, t, *_) in enumerate(edge_rows()) if t != "\x00"]
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})  # noqa: F841
    want = duckdb.sql(oracles.LINE_RULES)
    got = clean_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want.columns == got.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_vectors(spark):
    rng = random.Random(10)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    rows = [(n, [x + rng.gauss(0, 0.05) for x in base[n % 12]], n % 2) for n in range(120)] + [(500, None, 1), (501, [0.0] * 12, 1), (502, [1.0] * 11 + [None], 1), (503, base[0], None)]
    embeddings = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": pa.array([r[2] for r in rows], pa.int32())})  # noqa: F841
    want = duckdb.sql(oracles.VECTORS)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert want.columns == got.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
