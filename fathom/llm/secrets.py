"""Operator 1: secret scan by assignment-aware lexing.

A text that can hold an assignment is cut into names, string literals, bare values and operators, in the syntax that
source code and configuration share (``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``, ``name => x``,
``setName("x")``, ``<name>x</name>``, ``name="name" value="x"``).  A right side goes on over line ends after an operator,
within brackets, before or after a ``+``, after a backslash, in triple quotes and in the lines of a block that ``>`` or
``|`` announces.  Every target is bound to the literals of its right side; a name on a right side stands for what it
was bound to before, and ``+`` joins, so constants are followed to the place where they are spelled.  A literal is a
secret if the name it ends up in is a sensitive one and the value looks like a credential.  Plain patterns for
assignments, access key ids and long hex strings are always reported as well.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from functools import cache
from itertools import accumulate
from hashlib import sha256

from pyspark.sql import DataFrame

from fathom.llm.batches import ddl_of, map_batches, quoted

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Comments that hold no assignment of their own are passed over.
COMMENT = r"(?P<comment>/\*[^*=:(]*\*/|(?<!\S)(?:\#|//)[^\S\n][^\n=:(]*$)"
STRING = {'"': r'"(?:[^"\\\n]|\\.)*"', "'": r"'(?:[^'\\\n]|\\.)*'"}
TOKENS = r"""(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|[:=+(])|(?P<line>\n)|(?P<mark>[\[\]{}),])|(?P<other>[^\s"'A-Za-z_$:=+(\[\]{}),]+|\S)"""
#: By the quotes that strings may begin with.
LEX = {quotes: re.compile("|".join([COMMENT, *(["(?P<str>" + "|".join(STRING[q] for q in quotes) + ")"] if quotes else []), TOKENS]), re.ASCII | re.MULTILINE) for quotes in ("\"'", '"', "'", "")}
#: Elements with nothing but text in them, and pairs of attributes.
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
ATTRIBUTES = re.compile(r"""\b(?:name|key)\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)')\s+value\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)')""")
BARE = re.compile(r"[^\s,;\"'(){}\[\]]+")
#: A bare value that has the next line to itself and isn't an assignment of its own.
ALONE = re.compile(r"(?![\w.$-]+(?::|=[^=\s]))[^\s,;\"'(){}\[\]]+(?=[,;]?[^\S\n]*(?:\n|\Z))", re.ASCII)
#: The mark of a block of lines, and a line.
BLOCK = re.compile(r"[|>][0-9+-]*[^\S\n]*(?:#[^\n]*)?\n")
LINE = re.compile(r"([^\S\n]*)([^\n]*)(?:\n|\Z)")
#: What stands at the end of a line with such a mark, and perhaps of others.
MARKED = re.compile(r":[^\S\n]*[|>][0-9+-]*[^\S\n]*(?:#.*)?$")
#: What frames a key in base64 isn't part of its value.
FRAME = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----(?:\\[nr])*")
BINDS = {"=", ":", ":=", "=>", "("}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: How much a word in a target's name says that its value is secret.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "private": 1, "access": 1, "api": 1, "auth": 2, "bearer": 3, "signing": 1, "encryption": 1, "key": 2, "salt": 2, "pin": 1}
#: Words that say the value is about a secret, not one.
HARMLESS = {"public", "name", "path", "file", "url", "type", "length", "size", "count", "field", "label", "policy", "regex", "id", "header", "expiry", "ttl"}
#: Values that stand in for a secret.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|your.*|.*example.*|change_?me.*|none|null|true|false|undefined|todo|test|dummy|placeholder|redacted)$")
#: Name and value points from which a literal is reported.
THRESHOLD = 5.0
MIN_CHARS = 6
#: Characters of each end of a long value that are kept as text.
ENDS = 128


def name_points(name: str) -> float:
    words = [w.lower() for w in WORD.findall(name)]
    joined = sum(SENSITIVE.get(a + b, 0) for a, b in zip(words, words[1:]))
    return sum(SENSITIVE.get(w, 0) for w in words) + joined - 3 * sum(w in HARMLESS for w in words)


def value_points(value: str) -> float:
    """Length, entropy and mixture of characters of a value; negative for stand-ins and plain words."""
    if len(value) < MIN_CHARS or " " in value or PLACEHOLDER.match(value):
        return -10.0
    return _points(len(value), Counter(value), value[0])


def _points(n: int, counts: Counter, first: str) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)
    mixed = sum(bool(re.search(p, "".join(counts))) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(entropy, 4.0) / 2 + mixed / 2 + (n >= 16) / 2 - (mixed == 1 and "0" > first)


class Value:
    """What a name stands for: literals (value, start, end) and the values of other names, which are shared, not copied."""

    __slots__ = ("items", "n", "counts", "head", "tail", "example")

    def __init__(self, items: list):
        self.items, self.n = items, -1
        if any(isinstance(x, Value) for x in items):
            self.sum_up()  # so that no chain is gone down again

    def sum_up(self) -> None:
        if self.n >= 0:
            return
        self.n, self.counts, self.head, self.tail, self.example = 0, Counter(), "", "", False
        for x in self.items:
            if isinstance(x, Value):
                x.sum_up()
                n, counts, head, tail, example = x.n, x.counts, x.head, x.tail, x.example
            else:
                n, counts, head, tail, example = len(x[0]), Counter(x[0]), x[0][:ENDS], x[0][-ENDS:], "example" in x[0].lower()
            self.example = self.example or example or "example" in (self.tail[-6:] + head[:6]).lower()
            self.n += n
            self.counts.update(counts)
            self.head, self.tail = (self.head + head)[:ENDS], (self.tail + tail)[-ENDS:]

    def points(self) -> float:
        """``value_points`` of the literals joined, which may be too long to be written out."""
        self.sum_up()
        if self.n <= ENDS:
            return value_points(self.head)
        # the placeholders look at both ends, at which characters there are, and for one word
        if " " in self.counts or PLACEHOLDER.match(self.head + "example" * self.example + "".join(sorted(self.counts)) + self.tail):
            return -10.0
        return _points(self.n, self.counts, self.head[0])

    def spans(self, told: dict) -> list[tuple[int, int]]:
        """Places of all literals, without those of values in ``told``, to which this one's are added."""
        out, rest = [], [self]
        while rest:
            x = rest.pop()
            if not isinstance(x, Value):
                out.append(x[1:])
            elif id(x) not in told:
                told[id(x)] = x
                rest += x.items
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _lines(text: str, start: int, stop: int) -> list[tuple[str, int, int]]:
    """The lines from start to stop as literals, without the blanks around them."""
    out, at = [], start
    for line in text[start:stop].split("\n"):
        if bare := line.strip():
            a = at + line.index(bare)
            out.append((FRAME.sub("", bare), a, a + len(bare)))
        at += len(line) + 1
    return out


class Blocks:
    """The lines of a text and what stands further in below each of them: the block of a key that ``|`` or ``>`` ends.

    A block within another one is a value that both share, so lines in deep blocks aren't gone through once for each.
    """

    def __init__(self, text: str):
        self.text = text
        self.lines = [(m.start(), m[1], m[2]) for m in LINE.finditer(text) if m.start() < len(text)]
        self.starts = [start for start, _, _ in self.lines]
        # the first line behind each one that isn't blank and doesn't stand further in
        self.stops = [len(self.lines)] * len(self.lines)
        open_: list[int] = []
        for n, (_, blanks, rest) in enumerate(self.lines):
            if rest:
                while open_ and len(self.lines[open_[-1]][1]) >= len(blanks):
                    self.stops[open_.pop()] = n
                open_.append(n)
        self.values: dict[int, Value | None] = {}
        for n in range(len(self.lines) - 1, -1, -1):
            if MARKED.search(self.lines[n][2]):
                self.values[n] = self._value(n)

    def _value(self, key: int) -> Value | None:
        items: list = []
        n = key + 1
        while n < self.stops[key]:
            start, blanks, rest = self.lines[n]
            if bare := rest.strip():
                at = start + len(blanks) + rest.index(bare)
                items.append((FRAME.sub("", bare), at, at + len(bare)))
            inner = self.values.get(n)
            if inner is not None:
                items.append(inner)
                n = self.stops[n]
            else:
                n += 1
        return Value(items) if items else None

    def below(self, place: int) -> Value | None:
        """The lines below the one with a place, as one value; none if there is no text."""
        key = bisect_right(self.starts, place) - 1
        if key not in self.values:
            self.values[key] = self._value(key)
        return self.values[key]


def _right_side(text: str, tokens: list, op: int, bound: dict, blocks: Callable[[], Blocks]):
    """Literals (value, start, end) and values of names behind the operator at token ``op``, and the token to go on from.

    Block marks and triple quotes hold text that is read for assignments of its own as well.
    """

    def is_op(n: int, *ops: str) -> bool:
        return n < len(tokens) and tokens[n][0] == "op" and text[tokens[n][1] : tokens[n][2]] in ops

    def skipped(n: int) -> int:
        while n < len(tokens) and tokens[n][0] == "line":
            n += 1
        return n

    call = is_op(op, "(")
    found: list = []
    go_on = -1
    depth, at, bare, wrapped, after = int(call), op + 1, not call, False, True
    while at < len(tokens):
        kind, start, end = tokens[at]
        if kind == "line":
            n = skipped(at)
            if not after and not depth and not (bare is not None and is_op(n, "+") and n + 1 < len(tokens) and tokens[n + 1][0] in ("str", "name")):
                break
            at, wrapped = n, True
        elif kind == "other" and text[start:end] == "\\" and at + 1 < len(tokens) and tokens[at + 1][0] == "line":
            at, after, wrapped = at + 2, True, True
        elif not after and is_op(at, "+"):
            at, after = at + 1, True
        elif kind == "mark" and text[start] == "," and depth > call and not after:
            at, after = at + 1, True
        elif kind == "mark" and text[start] in ")]}" and depth > call:
            at, depth, after = at + 1, depth - 1, False
        elif after and (kind == "mark" and text[start] in "[{" or is_op(at, "(")):
            at, depth = at + 1, depth + 1
        elif text.startswith(('"""', "'''"), start) and kind in ("str", "other") and (after or depth):
            if (stop := text.find(text[start : start + 3], start + 3)) < 0:
                break
            found += _lines(text, start + 3, stop)
            go_on = at + 1 if go_on < 0 else go_on
            while at < len(tokens) and tokens[at][1] < stop + 3:
                at += 1
            after = False
        elif kind == "str" and (after or depth):
            if (depth or wrapped) and is_op(skipped(at + 1), ":", "=>", "=", ":="):
                break  # a key
            value = text[start + 1 : end - 1]
            found.append((FRAME.sub("", value), start + 1, end - 1))
            at, after = at + 1, False
        elif kind == "name" and after and text[start:end] in bound and not BARE.match(text, start).end() > end and not (wrapped and is_op(at + 1, *BINDS)):
            found.append(bound[text[start:end]])
            at, after = at + 1, False
        elif after and not found and is_op(op, ":") and not wrapped and (m := BLOCK.match(text, start)):
            if (below := blocks().below(tokens[op][1])) is not None:
                found.append(below)
            go_on = at + 1
            break
        elif after and bare and not found and (m := (ALONE if wrapped else BARE).match(text, start)) and (not depth or wrapped):
            found.append((m.group(), m.start(), m.end()))
            while at < len(tokens) and tokens[at][1] < m.end():
                at += 1
            after, bare = False, None  # a bare value doesn't go on in a line that begins with +
        else:
            break
    return found, max(op + 1, at if go_on < 0 else go_on)


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every token but comments.

    Once a quote isn't closed in its line, no later one of its kind in that line is, so strings aren't tried there again and
    the time is linear.
    """
    out: list[tuple[str, int, int]] = []
    at, stop, quotes = 0, len(text), "\"'"
    while at < len(text):
        for m in LEX[quotes].finditer(text, at, stop):
            kind, start, at = m.lastgroup, m.start(), m.end()
            if kind != "comment":
                out.append((kind, start, at))
            if kind == "other" and text[start] in quotes:
                quotes = quotes.replace(text[start], "")
                if (stop := text.find("\n", at)) < 0:
                    stop = len(text)
                break
        else:
            at, stop, quotes = stop, len(text), "\"'"
    return out


def element_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of secrets between tags, and in attributes beside the one that gives their name."""
    out = []
    pairs = [(m[1], m.span(2)) for m in ELEMENT.finditer(text)] if "</" in text else []
    if "value" in text:
        pairs += [(m[1] if m[2] is None else m[2], m.span(3) if m[4] is None else m.span(4)) for m in ATTRIBUTES.finditer(text)]
    for name, (start, end) in pairs:
        value = text[start:end]
        start, value = start + len(value) - len(value.lstrip()), value.strip()
        points = name_points(name)
        if points >= 2 and points + value_points(value) >= THRESHOLD:
            out.append((start, 3, start + len(value)))
    return out


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of literals that reach a sensitive name."""
    elements = element_spans(text)
    if "=" not in text and ":" not in text and "(" not in text:
        return elements
    bound: dict[str, Value] = {}
    out, told = set(elements), {}
    tokens = tokens_of(text)
    blocks = cache(lambda: Blocks(text))
    go_on = 1
    for n in [n for n, t in enumerate(tokens) if t[0] == "op"]:
        op = text[tokens[n][1] : tokens[n][2]]
        if n < go_on or op not in BINDS:
            continue
        target = n - 1
        if target < 0:
            continue
        while target > 0 and tokens[target][0] == "line" and op not in (":", "("):
            target -= 1
        if tokens[target][0] not in ("name", "str"):
            continue
        name = text[tokens[target][1] : tokens[target][2]].strip("\"'")
        literals, go_on = _right_side(text, tokens, n, bound, blocks)
        if literals:
            bound[name] = value = literals[0] if len(literals) == 1 and isinstance(literals[0], Value) else Value(literals)
            points = name_points(name)
            if points >= 2 and points + value.points() >= THRESHOLD:
                out.update((a, 3, b) for a, b in value.spans(told) if b > a)
    return sorted(out)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the lexed ones that no base span holds already."""
    base = base_spans(text)
    starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    lexed = [s for s in lexed_spans(text) if not (n := bisect_right(starts, s[0])) or ends[n - 1] < s[2]]
    return base, sorted(base + lexed)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans, n_literal)`` of every document.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined by commas;
    ``base_sha256`` is of the plain patterns' spans.  A null or empty text has none.  Repeated rows each give a row.
    """

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def task(parts):
        for keys, texts in parts:
            rows = []
            for key, text in zip(keys, texts):
                base, spans = all_spans(text or "")
                n = Counter(k for _, k, _ in spans)
                rows.append((key, n[0], n[1], n[2], sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
            yield [list(c) for c in zip(*rows)]

    return map_batches(docs, [id_col, text_col], f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long", task)


def redact_documents(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All documents in their own columns, with every secret in the text replaced by the mark.

    ``length_col`` is set to the new length where a text changes.  A null text stays null.
    """
    names = docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else -1

    def task(parts):
        for columns in parts:
            columns = list(columns)
            texts = columns[at]
            clean = [t and redact(t, all_spans(t)[1], mark) for t in texts]
            if length_at >= 0:
                columns[length_at] = [n if c == t else len(c) for n, c, t in zip(columns[length_at], clean, texts)]
            columns[at] = clean
            yield columns

    return map_batches(docs, [quoted(c) for c in names], ddl_of(docs), task)
