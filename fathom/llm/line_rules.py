"""Operator 6: line-first cleaning.

Every line is judged by itself; lines that fail are taken out, and then the document is rejected if too much of it
was lost.  Counts over the whole document decide a first rejection.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from fathom.llm.batches import ddl_of, map_batches, quoted

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rules: fewer words, or a larger share (per cent) of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Share of a document's words that its good lines must hold.
MIN_KEPT = 0.5
#: Share of a line's words that may carry symbols, exclamation runs or be dividers.
MAX_ODD_WORDS = 0.3
#: A line of at least so many words needs a sentence end or a comma somewhere.
LONG_LINE = 40

#: Ends of a sentence or clause; closing quotes and brackets may follow.
SENTENCE_END = re.compile(r"[.!?…:;,。！？][\"'”’)\]]*")
ODD_WORD = re.compile(r"[#*$%&|<>]{2,}|[!?]{2,}|^[|<>»›·•/\\-]+$")
DIVIDER = re.compile(r"\s[|»›·•]\s")
#: Phrases of page furniture, in English, German, French and Spanish; a short line that holds one is furniture.
BOILERPLATE = (
    *("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "use cookies", "enable javascript", "javascript is disabled", "skip to content", "sign in", "sign up", "log in", "click here", "read more", "subscribe to", "share this", "back to top", "lorem ipsum", "page not found", "copyright ©", "(c) copyright"),
    *("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "verwendet cookies", "zum inhalt springen", "hier klicken", "weiterlesen", "nach oben", "seite nicht gefunden"),
    *("tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "utilise des cookies", "aller au contenu", "cliquez ici", "lire la suite", "haut de page", "page introuvable"),
    *("todos los derechos reservados", "términos de uso", "política de privacidad", "aceptar cookies", "utiliza cookies", "saltar al contenido", "haz clic aquí", "leer más", "volver arriba", "página no encontrada"),
)
BOILERPLATE_WORDS = 25


def line_passes(line: str) -> bool:
    """Punctuation, navigation and boilerplate rules for a line that has a word."""
    words = line.split()
    n = len(words)
    if n and sum(bool(ODD_WORD.search(w)) for w in words) > MAX_ODD_WORDS * n:
        return False
    if len(DIVIDER.findall(line)) >= 3 and SENTENCE_END.search(line) is None:
        return False
    if n <= BOILERPLATE_WORDS:
        low = line.lower()
        if any(p in low for p in BOILERPLATE):
            return False
    return n < LONG_LINE or SENTENCE_END.search(line) is not None


def repeated_words(words: Sequence, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(window))))
    if len(set(windows)) == n:
        return 0
    seen: dict = {}
    again = bytearray(n)
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            again[first] = again[i] = 1
    covered, until = 0, 0
    for i in range(n):
        if again[i]:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, str]:
    """Words, their characters, symbols, repeated lines, repeated words, base failure, verdict, text of good lines."""
    words = text.encode().split()  # bytes: only \x20 and \x09-\x0D divide
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    worded = [line for line in lines if line.strip(SPACES)]
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    good = [line for line in lines if not line.strip(SPACES) or line_passes(line)]
    cleaned = text if len(good) == len(lines) else "\n".join(good)
    kept = not failed and (cleaned is text or len(cleaned.encode().split()) >= MIN_KEPT * n)
    return n, chars, symbols, len(worded) - len(set(worded)), repeats, failed, kept, cleaned


def clean_documents(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of every document.

    With ``with_text``, ``cleaned`` is the text of the lines that pass.  A null or empty text has no words, fails and
    isn't kept.  Repeated rows each give a row.
    """

    def task(parts):
        for keys, texts in parts:
            rows = [(key, *judge(t or "")) for key, t in zip(keys, texts)]
            yield [list(c) for c in zip(*rows)][: 9 if with_text else 8]

    ddl = f"{id_col} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_batches(docs, [id_col, text_col], ddl + ", cleaned string" * with_text, task)


def keep_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows whose document is kept, in their own columns, with the text of the lines that pass.

    ``length_col`` is set to the new length where lines went.  Null, empty and blank texts go.  Repeated rows stay or go
    alike; an empty table gives no rows.
    """
    names = docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else -1

    def task(parts):
        for columns in parts:
            found = [judge(t or "") for t in columns[at]]
            keep = [f[6] for f in found]
            if not any(keep):
                continue
            if length_at >= 0:
                columns[length_at] = [n if f[7] == t else len(f[7]) for n, f, t in zip(columns[length_at], found, columns[at])]
            columns[at] = [f[7] for f in found]
            yield [[v for v, k in zip(column, keep) if k] for column in columns]

    return map_batches(docs, [quoted(c) for c in names], ddl_of(docs), task)
