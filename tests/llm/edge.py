"""Documents with the cases that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, root string, `at.x` string, cell int, label int, spans string"


def edge_rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma.", "delta,", "été", "straße", "naïve", "12", "x1", "the", "of", "to"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \t\n ", "a", "***", "\x00", "word", prose(3), prose(400), prose(40) + ".\n" + prose(50) + ".", "x" * 30_000, "\n" * 2_000, prose(6_000), 'token = "ab12cd34ef56ab12cd34ef56"\n', "😀 字漢 <|endoftext|> <|startoftext|> ½Ⅷ²", "dup dup dup dup dup dup dup dup dup dup dup dup"]
    rows = [(n, t, "en", "s", None if t is None else len(t)) for n, t in enumerate(texts)]
    rows += [(8, texts[8], "en", "s", len(texts[8])), (100, texts[8], None, None, None), (None, texts[8], "en", "s", 1), (None, None, None, None, None), (101, texts[9] + " more", "de", "s", 5)]
    return [(*r, 1, 2, "r", "q", 3, 0, "z") for r in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
