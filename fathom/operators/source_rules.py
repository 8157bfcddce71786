"""Rules that need more than a line: captures compared, neighbours, running state, symbols, counts, whole-file patterns.

Each is a function of a file that yields findings.  They run together in one pass over files, so a file is read and cut
into lines once; files are independent, and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, wraps
from typing import NamedTuple

from fathom.functions.predicates import needed_pieces
from fathom.functions.text import split_lines


class Finding(NamedTuple):
    line: int
    column: int = 1
    message: str | None = None
    snippet: str | None = None
    severity: str | None = None
    edit: tuple[int, int, int, int, str] | None = None


class Limits(NamedTuple):
    complexity: int = 15
    params: int = 7
    nesting: int = 4


class SourceFile:
    def __init__(self, path: str, text: str, limits: Limits = Limits()):
        self.path, self.text, self.limits = path, text, limits
        self.lines = split_lines(text)

    @cached_property
    def trimmed(self) -> list[str]:
        return [line.strip() for line in self.lines]

    @cached_property
    def feeds(self) -> list[int]:
        """Places of line ends."""
        return [m.start() for m in re.finditer("\n", self.text)]

    @cached_property
    def braces(self) -> tuple[list[int], list[int | None]]:
        """Places of braces, and for each the number of the first from it on behind which as many are closed as opened."""
        at = [m.start() for m in re.finditer("[{}]", self.text)]
        depth, depths = 0, []
        for place in at:
            depths.append(depth)
            depth += 1 if self.text[place] == "{" else -1
        even, later = [None] * len(at), {depth: len(at)}
        for n in range(len(at) - 1, -1, -1):
            if depths[n] in later:
                even[n] = later[depths[n]] - 1
            later[depths[n]] = n
        return at, even

    @cached_property
    def heads(self) -> list[tuple[int, int]]:
        return heads(self.text)

    def body_from(self, at: int) -> str | None:
        """Text from the first brace behind ``at`` to where braces are even again, counting those in strings and comments too."""
        places, even = self.braces
        n = bisect_left(places, at)
        if n == len(places) or even[n] is None:
            return None
        start = next(p for p in places[n:] if self.text[p] == "{") if self.text[places[n]] == "}" else places[n]
        return self.text[start : places[even[n]] + 1]

    def reported_line(self, at: int) -> int:
        """Line given for a match at ``at``: the lines that its prefix has, and one more.

        A match that starts inside a line is so given the next line's number; the analysis defines it that way.
        """
        return bisect_left(self.feeds, at) + (1 if at == 0 or self.text[at - 1] == "\n" else 2)

    def numbered(self) -> Iterator[tuple[int, str, str]]:
        return zip(range(1, len(self.lines) + 1), self.lines, self.trimmed)

    def is_comment(self, n: int) -> bool:
        return self.trimmed[n - 1].startswith("//")


RULES: dict[str, Callable[[SourceFile], Iterator[Finding]]] = {}


def rule(key: str):
    def add(f):
        RULES[key] = f
        return f

    return add


def gated(pattern: str, check: Callable[[SourceFile], Iterator[Finding]]) -> Callable[[SourceFile], Iterator[Finding]]:
    """``check``, for files that hold a piece of text that every match of the pattern needs."""
    pieces, ignore = needed_pieces(pattern)
    if not pieces or ignore:
        return check
    return lambda source: check(source) if any(p in source.text for p in pieces) else iter(())


#: A pattern that a line has to match before a rule finds anything in its file, and the rule's bit.
NEEDS: dict[str, tuple[re.Pattern, int]] = {}
#: Rules to which lines that don't match it make no difference, so they go through the others only.
ALONE: set[str] = set()
#: Different lines whose values a worker keeps, and their characters at most; and the same of longer ones.
KEPT_LINES, KEPT_CHARS, LONG_LINES, LONG_CHARS = 1 << 14, 1000, 1 << 8, 1 << 14
#: Series of lines whose findings a worker keeps for a rule, of ``KEPT_CHARS`` characters at most.
KEPT_SERIES = 1 << 12


#: Rules of ``ALONE`` whose findings on a line depend on nothing else, so each different line is judged once.
PURE: set[str] = set()
#: Rules of ``ALONE`` whose findings depend on the lines that they go through and their order only, not on where these stand.
SERIAL: set[str] = set()
#: Further patterns of lines that make a difference to a rule, and the bits of each.
ALSO: dict[str, int] = {}
#: A brace, which what keeps count of them looks at.
BRACE = r"[{}]"


def needs(key: str, pattern: str | re.Pattern, alone: bool = False, also: tuple[str | re.Pattern, ...] = ()) -> None:
    """``also`` are patterns of the only other lines that make a difference to the rule."""
    NEEDS[key] = (re.compile(pattern), _bit(pattern))
    if alone or also:
        ALONE.add(key)
        ALSO[key] = sum({_bit(p) for p in also})


_BITS: dict[re.Pattern, int] = {}


def _bit(pattern: str | re.Pattern) -> int:
    return _BITS.setdefault(re.compile(pattern), 1 << len(_BITS))


def kept(f: Callable[[str], object]) -> Callable[[str], object]:
    """A function of a line, whose values are kept for lines that come again and again."""
    known, long = lru_cache(maxsize=KEPT_LINES)(f), lru_cache(maxsize=LONG_LINES)(f)

    @wraps(f)  # a task finds it by its name
    def value(line):
        return known(line) if len(line) <= KEPT_CHARS else long(line) if len(line) <= LONG_CHARS else f(line)

    return value


@kept
def line_bits(line: str) -> int:
    """The bits of the patterns that rules need and that the line matches."""
    return sum(bit for pattern, bit in _BITS.items() if pattern.search(line))


class _Bits(dict):
    """:func:`line_bits` by line; emptied when it is full."""

    def __missing__(self, line: str) -> int:
        bits = line_bits(line)
        if len(line) <= KEPT_CHARS:
            if len(self) >= KEPT_LINES:
                self.clear()
            self[line] = bits
        return bits


_KNOWN_BITS = _Bits()


def bits_of(lines: list[str]) -> list[int]:
    """The :func:`line_bits` of each line."""
    return list(map(_KNOWN_BITS.__getitem__, lines))


@lru_cache(maxsize=None)
def searched(pattern: str) -> Callable[[str], tuple[str, ...] | None]:
    """A function that finds a pattern's first match in a line, as its whole text and its groups; made where it is used."""
    compiled = re.compile(pattern)

    def groups(line: str) -> tuple[str, ...] | None:
        m = compiled.search(line)
        return m and (m[0], *m.groups())

    return kept(groups)


class SomeLines:
    """A file of which only some lines are gone through: those with any of the bits."""

    def __init__(self, source: SourceFile, bits: list[int], any_of: int):
        self._source, self._places = source, [n for n, b in enumerate(bits) if b & any_of]

    def numbered(self) -> Iterator[tuple[int, str, str]]:
        return ((n + 1, self._source.lines[n], self._source.trimmed[n]) for n in self._places)

    def __getattr__(self, name: str):
        return getattr(self._source, name)


def from_word(pattern: str) -> re.Pattern:
    """A pattern that begins with a word, compiled to begin where a word does.

    Its matches are the same, since one that began within a word would begin at the word's first letter, and it doesn't go
    through a long word once for each letter.
    """
    return re.compile(r"(?<!\w)" + pattern if pattern.startswith((r"(\w+)", r"\w+")) else pattern)


def ended(text: str, pattern: re.Pattern, end: re.Pattern, known: list[tuple[int, int]] | None = None) -> Iterator[re.Match]:
    """``pattern.finditer(text)`` where ``pattern`` is two words or more and white space, ``\\([^)]*`` and ``end``.

    ``end`` begins with its only ``)`` and what it matches begins with a match of ``METHOD_END``.  The pattern is tried between
    the ``)`` of an end and the one before, from where two words may stand before a bracket, and nowhere else; ``known`` has
    these places if they have been found.
    """
    for start, close in heads(text) if known is None else known:
        if (m := end.match(text, close)) and (found := pattern.search(text, start, m.end())):
            yield found


def heads(text: str) -> list[tuple[int, int]]:
    """Where what may be a method's head begins at the earliest, and the place of its ``)``."""
    out = []
    for m in METHOD_END.finditer(text):
        begin = text.rfind(")", 0, m.start()) + 1
        if (start := _head_start(text[begin : m.start()])) is not None:
            out.append((begin + start, m.start()))
    return out


@kept
def _head_start(part: str) -> int | None:
    """A place before the first two words that stand, with white space only, before a ``(`` in a part of a text; None without any."""
    start = 0
    while (at := part.find("(", start)) >= 0:
        begin = max(start, part.rfind(";", start, at) + 1, part.rfind("{", start, at) + 1, part.rfind("}", start, at) + 1)
        words = part[begin:at].rsplit(None, 2)
        if len(words) > 1 and words[-1].replace("_", "a").isalnum() and words[-2][-1:].replace("_", "a").isalnum():
            return begin
        start = at + 1
    return None


def byte_column(line: str, at: int) -> int:
    return len(line[:at].encode()) + 1


# Type, method and keyword names and the patterns that go with them.
TRY_RESOURCES = ["FileInputStream", "FileOutputStream", "BufferedReader", "BufferedWriter", "FileReader", "FileWriter", "Connection", "Statement", "ResultSet", "InputStream", "OutputStream", "Scanner", "Socket", "ServerSocket", "DataInputStream", "DataOutputStream", "ObjectInputStream", "ObjectOutputStream"]
CLOSED_RESOURCES = ["InputStream", "OutputStream", "Reader", "Writer", "Connection", "Statement", "PreparedStatement", "ResultSet", "Socket", "ServerSocket", "FileInputStream", "FileOutputStream", "BufferedReader", "BufferedWriter", "PrintWriter", "Scanner", "Channel", "Selector"]
PURE_METHODS = ["replace", "replaceAll", "replaceFirst", "trim", "strip", "toUpperCase", "toLowerCase", "substring", "concat", "split", "format", "valueOf", "toString", "abs", "min", "max", "ceil", "floor", "round", "sqrt", "pow", "intern"]
DECLARING_WORDS = {"class", "interface", "enum", "void", "abstract", "static", "final"}
PRIMITIVES = {"int", "long", "double", "float", "boolean", "byte", "short", "char"}
COMMENTED_CODE = [r"//\s*(?:if|for|while|return|public|private|protected|class)\s*[\(\{]", r"//\s*\w+\s*\.\s*\w+\s*\(", r"//\s*\w+\s*=\s*\w+", r"/\*\s*(?:if|for|while|return|public|private)"]
ASSERTING = ("assert", "verify", "expect")
DECISIONS = [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bcase\s+", r"\bcatch\s*\(", r"\?", r"&&", r"\|\|"]
DECISION_WORDS = ["if", "else", "for", "while", "do", "case", "catch", "?", "&&", "||"]
CAMEL, PASCAL, UPPER_SNAKE = r"[a-z][a-zA-Z0-9]*", r"[A-Z][a-zA-Z0-9]*", r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)*"
#: A head begins with white space or a word, or with a modifier at the end of one; nowhere else, so words aren't gone through twice.
METHOD = re.compile(r"(?:(?<!\w)(?=\w)|(?<!\s)(?=\s)|(?=public|private|protected|static))(?:public|private|protected)?\s*(?:static\s+)?(?:\w+)\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{")


#: What a head ends with; possessive, so white space is gone through once.
METHOD_END = re.compile(r"\)\s*+(?:throws\s[\w,\s]++)?\{")


# Captures that are compared


def each_capture(key: str, pattern: str, wrong: Callable[[re.Match], bool], comments: bool = True, first: bool = False, column: int | None = None, named: bool = False):
    """A finding for each match on a line whose groups are wrong; with ``first``, only a line's first match is looked at.

    ``column`` is the group whose place is given and, if ``named``, whose text is shown instead of the line.
    """
    compiled = from_word(pattern)

    def check(source: SourceFile) -> Iterator[Finding]:
        for n, line, trimmed in source.numbered():
            if not comments and trimmed.startswith("//"):
                continue
            for m in compiled.finditer(line):
                if wrong(m):
                    yield Finding(n, 1 if column is None else byte_column(line, m.start(column)), snippet=m[column] if named else trimmed)
                if first:
                    break

    RULES[key] = gated(pattern, check)
    needs(key, compiled, alone=True)
    PURE.add(key)


each_capture("Bug:S1201", r"boolean\s+equals\s*\(\s*(\w+)\s+\w+\s*\)", lambda m: m[1] != "Object", first=True)
each_capture("Bug:S2121", r"public\s+boolean\s+equals\s*\(\s*(\w+)\s+\w+\s*\)", lambda m: m[1] != "Object", first=True)
each_capture("Bug:S1656", r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*;", lambda m: m[1] == m[2])
each_capture("Bug:S1764", r"(\w+)\s*(==|!=|&&|\|\||<=|>=|<|>|\+|-|\*|/|%|\^|&|\|)\s*(\w+)", lambda m: m[1] == m[3] and m[2] not in "+*" and not (m[1] == "null" and m[2] in ("==", "!=")))
each_capture("Bug:S2114", r"(\w+)\.(addAll|removeAll|containsAll|retainAll)\s*\(\s*(\w+)\s*\)", lambda m: m[1] == m[3])
each_capture("Bug:S2251", r"for\s*\([^;]+;\s*(\w+)\s*(<|>|<=|>=)\s*[^;]+;\s*(\w+)(--|\+\+|-)", lambda m: m[1] == m[3] and (m[2][0] == "<") == (m[4] != "++"), first=True)
each_capture("CodeSmell:S1164", r"catch\s*\(\s*(\w+)\s+(\w+)\s*\)\s*\{\s*throw\s+(\w+)\s*;", lambda m: m[2] == m[3], first=True)
each_capture("CodeSmell:S1170", r"public\s+static\s+final\s+(\w+)", lambda m: m[1] != "class", comments=False, first=True)
each_capture("CodeSmell:S2176", r"class\s+(\w+)\s+extends\s+\w+\s+implements\s+(.+)", lambda m: m[1] in m[2], first=True)
each_capture("CodeSmell:S3077", r"volatile\s+(\w+)\s+\w+", lambda m: m[1] not in PRIMITIVES, first=True)
each_capture("CodeSmell:S112", r"throw\s+new\s+(Exception|RuntimeException|Throwable|Error)\s*\(", lambda m: True, first=True, column=1)
each_capture("CodeSmell:S1181", r"catch\s*\(\s*(Throwable|Error|java\.lang\.Throwable|java\.lang\.Error)\s+", lambda m: True, column=1)
each_capture("Naming:S1312", r"(Logger|Log)\s+(\w+)\s*=", lambda m: m[2] not in ("LOG", "LOGGER", "log", "logger"), first=True, column=2, named=True)


@rule("CodeSmell:S4165")
def first_self_assignment(source):
    assigned = from_word(r"(\w+)\s*=\s*(\w+)\s*;")
    for n, line, trimmed in source.numbered():
        m = assigned.search(line)
        if m and m[1] == m[2]:
            yield Finding(n, snippet=trimmed)


@rule("Naming:S115")
def constant_names(source):
    for n, line, trimmed in source.numbered():
        m = re.search(r"(static\s+final|final\s+static)\s+\w+\s+(\w+)", line)
        if m and not re.fullmatch(UPPER_SNAKE, m[2]) and not m[2].startswith("log") and m[2] != "serialVersionUID":
            from fathom.functions.naming import to_upper_snake_case

            at = byte_column(line, m.start(2))
            yield Finding(n, at, snippet=m[2], edit=(n, at, n, at + len(m[2].encode()), to_upper_snake_case(m[2])))


@rule("Naming:S116")
def field_names(source):
    for n, line, trimmed in source.numbered():
        if "static" in line and "final" in line:
            continue
        m = re.search(r"private\s+(\w+)\s+(\w+)\s*[;=]", line)
        if m and not re.fullmatch(CAMEL, m[2]):
            yield Finding(n, byte_column(line, m.start(2)), snippet=m[2])


@rule("Security:S5344")
def weak_password_hash_cost(source):
    for n, line, trimmed in source.numbered():
        if any(w in line for w in ("BCrypt", "PBKDF2", "Argon2")) and ("cost" in line or "iterations" in line):
            m = re.search(r"cost\s*[=:]\s*(\d+)", line)
            if m and int(m[1]) < 10:
                yield Finding(n, snippet=trimmed)


@rule("Bug:S2110")
def calendar_values(source):
    for n, line, trimmed in source.numbered():
        for pattern, least, most in ((r"Calendar\.MONTH\s*,\s*(\d+)", 0, 11), (r"Calendar\.DAY_OF_MONTH\s*,\s*(\d+)", 1, 31)):
            for m in re.finditer(pattern, line):
                if not least <= int(m[1]) <= most:
                    yield Finding(n, snippet=trimmed)


@rule("Bug:S2185")
def silly_arithmetic(source):
    for n, line, trimmed in source.numbered():
        same = any(m[1] == m[3] for m in re.finditer(r"\b(\w+)\s*([/\-%])\s*(\w+)\b", line))
        if same or re.search(r"\b\w+\s*\*\s*0\b|\b0\s*\*\s*\w+\b", line):
            yield Finding(n, snippet=trimmed)


@rule("Bug:S2275")
def format_arguments(source):
    specifier = re.compile(r"%(?:\d+\$)?[-#+ 0,(<]*\d*(?:\.\d+)?[bBhHsScCdoxXeEfgGaAtTnN]")
    for n, line, trimmed in source.numbered():
        for m in re.finditer(r'(?:printf|format)\s*\(\s*"([^"]*)"(?:\s*,\s*([^)]+))?\)', line):
            wanted = len(specifier.findall(m[1]))
            given = 0 if m[2] is None else len(m[2].split(","))
            if wanted and wanted != given:
                yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S2178")
def bitwise_logic(source):
    for n, line, trimmed in source.numbered():
        if re.search(r"\s+([&|])\s+", line) and "&&" not in line and "||" not in line:
            yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S109")
def magic_numbers(source):
    for n, line, trimmed in source.numbered():
        if trimmed.startswith("//") or "static final" in line:
            continue
        m = re.search(r"[=<>+\-*/]\s*(\d{2,})[^dDfFlL]", line)
        if m and int(m[1]) not in (0, 1, 10, 100):
            yield Finding(n, byte_column(line, m.start(1)), snippet=trimmed)


@rule("CodeSmell:S1104")
def public_fields(source):
    for n, line, trimmed in source.numbered():
        if "static" in line and "final" in line:
            continue
        m = re.search(r"public\s+(\w+)\s+(\w+)\s*[;=]", line)
        if m and m[1] not in DECLARING_WORDS:
            yield Finding(n, byte_column(line, m.start(2)), snippet=trimmed)


# Single lines that the predicate notation can't say


@rule("Security:S3649")
def sql_concatenation(source):
    concat, text = re.compile(r"(executeQuery|executeUpdate|execute|prepareStatement)\s*\([^)]*\+"), re.compile(r'".*?(SELECT|INSERT|UPDATE|DELETE|WHERE).*?"\s*\+')
    for n, line, trimmed in source.numbered():
        if concat.search(line) or text.search(line.upper()):
            yield Finding(n, snippet=trimmed)


@rule("Security:S6293")
def regex_weight(source):
    for n, line, trimmed in source.numbered():
        if "Pattern.compile" in line and sum(map(line.count, "+*?")) > 5:
            yield Finding(n, snippet=trimmed)


@rule("Bug:S1221")
def misspelled_methods(source):
    for n, line, trimmed in source.numbered():
        if "@Override" in line:
            continue
        low = line.lower()
        # the line is in lower case, so only names without capitals in their return type can match
        for pattern in (r"\b(int|Integer)\s+hashcode\s*\(", r"\bString\s+tostring\s*\(", r"\bboolean\s+equal\s*\("):
            if re.search(pattern, low):
                yield Finding(n, snippet=trimmed)


@rule("Bug:S2201")
def unused_results(source):
    calls = re.compile(rf"^\s*\w+\.\s*({'|'.join(PURE_METHODS)})\s*\([^)]*\)\s*;")
    for n, line, trimmed in source.numbered():
        if m := calls.match(line):
            yield Finding(n, message=f"The return value of '{m[1]}' must be used.", snippet=trimmed)


@rule("CodeSmell:S125")
def commented_code(source):
    any_of = re.compile("|".join(f"(?:{p})" for p in COMMENTED_CODE))
    for n, line, trimmed in source.numbered():
        if any_of.search(line):
            yield Finding(n, snippet=trimmed)


@rule("Complexity:S1067")
def boolean_operators(source):
    for n, line, trimmed in source.numbered():
        if line.count("&&") + line.count("||") > 3:
            yield Finding(n, snippet=trimmed)


# Files and lines with facts of their file


@rule("Bug:S1206")
def equals_without_hash(source):
    equals = "boolean equals(Object" in source.text or "public boolean equals(" in source.text
    if equals != ("int hashCode()" in source.text) and (at := source.text.find("class ")) >= 0:
        yield Finding(len(split_lines(source.text[:at])) + 1)


@rule("CodeSmell:S1210")
def equals_or_hash(source):
    equals = "boolean equals(Object" in source.text or "boolean equals(java.lang.Object" in source.text
    if equals != ("int hashCode()" in source.text):
        yield Finding(1)


@rule("CodeSmell:S1220")
def no_package(source):
    if not any(t.startswith("package ") for t in source.trimmed):
        yield Finding(1)


@rule("CodeSmell:S1451")
def no_copyright(source):
    if not any("Copyright" in line or "copyright" in line for line in source.lines[:10]):
        yield Finding(1)


@rule("CodeSmell:S110")
def deep_inheritance(source):
    if len(re.findall(r"class\s+\w+\s+extends\s+\w+", source.text)) > 5:
        yield Finding(1)


@rule("CodeSmell:S1118")
def utility_constructor(source):
    if "static" in source.text and "new " not in source.text and re.search(r"public\s+\w+\s*\(\s*\)", source.text):
        yield Finding(1)


@rule("CodeSmell:S1694")
def abstract_without_methods(source):
    if not any("abstract" in line and "(" in line and "class" not in line for line in source.lines):
        for n, line, trimmed in source.numbered():
            if re.search(r"abstract\s+class\s+(\w+)", line):
                yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S5958")
def test_class_names(source):
    type_ = searched(r"class\s+(\w+)")
    if "@Test" in source.text:
        for n, line, trimmed in source.numbered():
            m = type_(line)
            if m and not m[1].endswith(("Test", "Tests")):
                yield Finding(n, snippet=trimmed)


# Neighbouring lines


def cookie_flag(key: str, call: str):
    def check(source):
        for n, line, trimmed in source.numbered():
            if re.search(r"new\s+Cookie\s*\(", line) and not any(call in x for x in source.lines[max(0, n - 6) : n + 10]):
                yield Finding(n, snippet=trimmed)

    RULES[key] = check
    needs(key, r"new\s+Cookie\s*\(", alone=True)


cookie_flag("Security:S2089", "setHttpOnly(true)")
cookie_flag("Security:S2092", "setSecure(true)")


@rule("Security:S2095")
def resource_outside_try(source):
    def guarded(n):
        for line in reversed(source.lines[max(0, n - 10) : n]):
            if re.search(r"try\s*\(", line):
                return True
            if "{" in line and "try" not in line:
                return False
        return False

    for n, line, trimmed in source.numbered():
        if any(f"new {t}" in line for t in TRY_RESOURCES) and not guarded(n):
            yield Finding(n, snippet=trimmed)


@rule("Bug:S2095")
def resource_not_closed(source):
    made = re.compile(rf"new\s+({'|'.join(CLOSED_RESOURCES)})\s*\(")
    for n, line, trimmed in source.numbered():
        names = dict.fromkeys(m[1] for m in made.finditer(line))
        if names and not any("try (" in x or "try(" in x for x in source.lines[max(0, n - 4) : n]):
            for name in names:
                yield Finding(n, message=f"Use try-with-resources to ensure {name} is closed.", snippet=trimmed)


@rule("Bug:S2272")
def iterator_next(source):
    if "implements" in source.text and "Iterator" in source.text:
        for n, line, trimmed in source.numbered():
            if "public" in line and "next()" in line and not any("NoSuchElementException" in x for x in source.lines[n - 1 : n + 29]):
                yield Finding(n, snippet=trimmed)


@kept
def _tested(line: str) -> tuple[int, bool, bool]:
    """By how much a line changes the depth of braces, and if it opens one, and asserts something."""
    return line.count("{") - line.count("}"), "{" in line, any(w in line for w in ("assert", "Assert.", "verify", "expect", "should"))


@rule("Bug:S2699")
def test_without_assertion(source):
    for n, line, trimmed in source.numbered():
        if "@Test" not in line:
            continue
        depth, opened, asserted = 0, False, False
        for body in source.lines[n - 1 : n + 49]:
            change, opens, asserts = _tested(body)
            depth += change
            opened |= opens
            asserted |= asserts
            if opened and depth <= 0:
                break
        if opened and not asserted:
            yield Finding(n, snippet=trimmed)


@rule("Bug:S5413")
def remove_in_loop(source):
    for n, line, _ in source.numbered():
        if "for (" in line and ":" in line:
            hit = next((k for k in range(n, min(len(source.lines), n + 9) + 1) if ".remove(" in source.lines[k - 1]), None)
            if hit:
                yield Finding(hit, snippet=source.trimmed[hit - 1])


@rule("Bug:S1751")
def loop_that_runs_once(source):
    for n, line, trimmed in source.numbered():
        if re.search(r"\b(for|while)\s*\([^)]*\)\s*\{", line):
            body = next((t for t in source.trimmed[n : n + 4] if t and t != "{"), "")
            if body.startswith(("return", "break", "throw")):
                yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S1488")
def variable_only_returned(source):
    for n, line, trimmed in source.numbered():
        if n == len(source.lines) or "return" not in source.lines[n]:
            continue
        m = from_word(r"(\w+)\s+(\w+)\s*=\s*[^;]+;").search(line)
        if m and (r := re.search(r"return\s+(\w+)\s*;", source.lines[n])) and r[1] == m[2]:
            yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S128")
def case_falls_through(source):
    for n, line, trimmed in source.numbered():
        if n < len(source.lines) and ("case " in line or trimmed.endswith(":")) and source.trimmed[n].startswith("case "):
            if not trimmed.endswith(":") and not any(w in line for w in ("break", "return", "throw", "continue")):
                yield Finding(n, snippet=trimmed)


# Running state


def blocks(source: SourceFile, starts: Callable[[str], object], again: bool = True, sinks: bool = False) -> Iterator[tuple[int, list[str]]]:
    """(first line, lines up to where its braces are even again) of blocks; a block ends on a line with a closing brace.

    The brace counter is signed.  With ``again``, a start inside a block begins a new one in its place.  ``sinks`` lets
    more closing than opening braces end a block too.
    """
    start, depth = 0, 0
    for n, line, _ in source.numbered():
        if (again or not start) and starts(line):
            start, depth = n, 0
        if start:
            depth += line.count("{") - line.count("}")
            if "}" in line and (depth == 0 or (sinks and depth < 0)):
                yield start, source.lines[start - 1 : n]
                start = 0


def block_rule(key: str, start: str, looked_for: str, wrong: Callable[[list[str]], bool], **how):
    """``looked_for`` is a pattern of the lines in a block that make a difference to ``wrong``."""

    def check(source):
        for n, body in blocks(source, _counting(start), **how):
            if wrong(body):
                yield Finding(n)

    RULES[key] = gated(start, check)
    needs(key, start, also=(BRACE, looked_for))
    SERIAL.add(key)


@lru_cache(maxsize=None)
def _counting(pattern: str) -> Callable[[str], int]:
    """A function that counts a pattern's matches in a line; made where it is used, since it can't be sent to a task."""
    return kept(lambda line: len(re.findall(pattern, line)))


def total(body: list[str], pattern: str) -> int:
    return sum(map(_counting(pattern), body))


block_rule("Bug:S1114", r"void\s+finalize\s*\(\s*\)", r"super\.finalize\s*\(\s*\)", lambda body: not total(body, r"super\.finalize\s*\(\s*\)"), sinks=True)
block_rule("Bug:S2097", r"public\s+boolean\s+equals\s*\(\s*Object", r"instanceof|getClass\(\)", lambda body: not any("instanceof" in x or "getClass()" in x for x in body), sinks=True)
block_rule("CodeSmell:S131", r"switch\s*\([^)]+\)", "default ?:", lambda body: not any("default:" in x or "default :" in x for x in body))
block_rule("CodeSmell:S135", r"(?:for|while)\s*\(", r"\bbreak\s*;|\bcontinue\s*;", lambda body: total(body, r"\bbreak\s*;|\bcontinue\s*;") > 1, again=False)
block_rule("CodeSmell:S1142", r"(?:public|private|protected)\s+(?:static\s+)?(?:\w+)\s+(\w+)\s*\(", r"\breturn\b", lambda body: total(body, r"\breturn\b") > 3)


@rule("Bug:S2276")
def wait_without_condition(source):
    inside, tested, depth = False, False, 0
    for n, line, trimmed in source.numbered():
        if not inside and re.search(r"while\s*\(", line):
            inside, tested, depth = True, False, 0
        if inside:
            depth += line.count("{") - line.count("}")
            tested |= "if " in line or "if(" in line
            if not tested and re.search(r"\.wait\s*\(", line):
                yield Finding(n, snippet=trimmed)
            inside = depth != 0


@rule("CodeSmell:S6301")
def test_method_without_assertion(source):
    start, depth, asserted = 0, 0, False
    for n, line, _ in source.numbered():
        if "@Test" in line:
            start, asserted = n, False
        if start and re.search(r"void\s+(\w+)\s*\(", line):
            depth = 0
        if start:
            depth += line.count("{") - line.count("}")
            asserted |= any(w in line for w in ASSERTING)
            if depth == 0 and "}" in line:
                if not asserted:
                    yield Finding(start)
                start = 0


@rule("Bug:S1862")
def repeated_condition(source):
    condition_of = searched(r"(?:if|else\s+if)\s*\(([^)]+)\)")
    chain: set[str] = set()
    for n, line, trimmed in source.numbered():
        if m := condition_of(line):
            condition = m[1].strip()
            if condition in chain:
                yield Finding(n, snippet=trimmed)
            chain = chain | {condition} if "else if" in line else {condition}


@rule("Bug:S2273")
def wait_outside_synchronized(source):
    waits, inside = searched(r"\.\s*(wait|notify|notifyAll)\s*\("), False
    for n, line, trimmed in source.numbered():
        inside |= "synchronized" in line
        if waits(line) and not inside:
            yield Finding(n, snippet=trimmed)
        if "}" in line:
            inside = False


@rule("Bug:S1226")
def parameter_assigned(source):
    head, assigned = searched(r"(?:public|private|protected)\s+\w+\s+\w+\s*\(([^)]+)\)"), searched(r"^\s*(\w+)\s*=\s*[^=]")
    params: set[str] | None = None
    depth = 0
    for n, line, trimmed in source.numbered():
        if m := head(line):
            params, depth = {p.split()[-1] for p in m[1].split(",") if len(p.split()) > 1}, 0
        if params is not None:
            depth += line.count("{") - line.count("}")
            if (m := assigned(line)) and m[1] in params:
                yield Finding(n, snippet=trimmed)
            if depth <= 0:  # also where the brace is on the next line
                params = None


@rule("CodeSmell:S1226")
def first_parameter_assigned(source):
    head = searched(r"(?:public|private|protected)[^{]+\(\s*(?:final\s+)?(\w+)\s+(\w+)")
    params: list[str] = []
    for n, line, trimmed in source.numbered():
        if m := head(line):
            params.append(m[2])
        if "=" in line and "==" not in line:
            for name in params:
                if name in line and re.search(rf"\b{re.escape(name)}\s*=[^=]", line):
                    yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S1165")
def exception_fields(source):
    opens, field, inside = searched(r"class\s+\w*Exception"), searched(r"(?:private|protected|public)\s+(\w+)\s+\w+"), False
    for n, line, trimmed in source.numbered():
        inside |= opens(line) is not None
        if inside:
            if field(line) and "final" not in line:
                yield Finding(n, snippet=trimmed)
            if "}" in line and "{" not in line:
                inside = False


@rule("CodeSmell:S1219")
def label_in_switch(source):
    label, inside = searched(r"^\s*(\w+)\s*:"), False
    for n, line, trimmed in source.numbered():
        inside |= "switch" in line and "(" in line
        if inside:
            m = label(line)
            if m and m[1] not in ("case", "default"):
                yield Finding(n, snippet=trimmed)
        if "}" in line:
            inside = False


@rule("CodeSmell:S1223")
def method_named_like_class(source):
    type_, method, name = searched(r"class\s+(\w+)"), searched(r"(?:public|private|protected)\s+(\w+)\s+(\w+)\s*\("), ""
    for n, line, trimmed in source.numbered():
        if m := type_(line):
            name = m[1]
        if name and (m := method(line)) and m[2] == name and m[1] != "void":
            yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S1700")
def field_named_like_class(source):
    type_, field, name = searched(r"class\s+(\w+)"), searched(r"(?:private|public|protected)\s+(?:static\s+)?\w+\s+(\w+)\s*[=;]"), ""
    for n, line, trimmed in source.numbered():
        if m := type_(line):
            name = m[1]
        if name and (m := field(line)) and m[1] == name:
            yield Finding(n, snippet=trimmed)


@rule("CodeSmell:S134")
def nesting(source):
    level = 0
    for n, line, trimmed in source.numbered():
        if trimmed.startswith(("if ", "if(", "for ", "for(", "while ", "while(", "switch ", "switch(", "try ")):
            level += 1
            if level > source.limits.nesting:
                yield Finding(n, snippet=trimmed)
        if "}" in line and not trimmed.startswith("//"):
            level = max(0, level - 1)


@rule("CodeSmell:S1151")
def long_cases(source):
    start = 0
    for n, line, _ in source.numbered():
        if "case " in line or "default:" in line:
            if start and n - start > 10:
                yield Finding(start)
            start = n


@rule("Complexity:S1151")
def wide_cases(source):
    start = 0
    for n, _, trimmed in source.numbered():
        if trimmed.startswith(("case ", "default:")):
            if start and n - start > 5:
                yield Finding(start)
            start = n


# Symbols of a file


@rule("Bug:S1850")
def needless_instanceof(source):
    declared = None
    for n, line, trimmed in source.numbered():
        for m in from_word(r"(\w+)\s+instanceof\s+(\w+)").finditer(line) if "instanceof" in line else ():
            if declared is None:
                declared = {m[2]: m[1] for m in from_word(r"(\w+)\s+(\w+)\s*[=;]").finditer(source.text)}
            if declared.get(m[1]) == m[2]:
                yield Finding(n, snippet=trimmed)


@rule("Bug:S2696")
def instance_writes_static(source):
    fields = sorted({m[1] for m in re.finditer(r"static\s+(?:\w+\s+)?(\w+)\s*[=;]", source.text)}) if "static" in source.text else []
    head, inside, depth = searched(r"(?:public|private|protected)\s+\w+\s+\w+\s*\([^)]*\)\s*\{"), False, 0
    for n, line, trimmed in source.numbered() if fields else ():
        if "static" not in line and head(line):
            inside, depth = True, 0
        if inside:
            depth += line.count("{") - line.count("}")
            inside = depth > 0
            for f in fields:
                if any(f + end in line for end in (" =", "=", "++", "--")):
                    yield Finding(n, message=f"Don't write static field '{f}' in an instance method.", snippet=trimmed)


COMPARED = from_word(r'(\w+)\s*(==|!=)\s*(\w+|"[^"]*")')
BOXED = re.compile(r"\b(?:String|Integer|Long|Double|Float|Boolean)\s+(\w+)")


@kept
def _compared(line: str) -> list[tuple[str, str]]:
    """What is compared with what in a line."""
    return [(m[1], m[3]) for m in COMPARED.finditer(line)] if "==" in line or "!=" in line else []


@rule("Bug:S4973")
def boxed_compared(source):
    declared = None
    for n, line, trimmed in source.numbered():
        for a, b in _compared(line):
            if "null" in (a, b):
                continue
            if declared is None and not b.startswith('"'):
                declared = {m[1] for m in BOXED.finditer(source.text)}
            if b.startswith('"') or a in declared or b in declared:
                yield Finding(n, snippet=trimmed)


@lru_cache(maxsize=None)
def captured(pattern: str | re.Pattern) -> Callable[[str], list[str]]:
    """A function that finds the first groups of a pattern's matches in a line; made where it is used."""
    compiled = re.compile(pattern)
    return kept(lambda line: [m[1] for m in compiled.finditer(line)])


@rule("CodeSmell:S1144")
def unused_private_field(source):
    names = captured(r"private\s+(?:static\s+)?(?:final\s+)?(?:\w+)\s+(\w+)\s*[;=]")
    places = {name: n for n, line, _ in source.numbered() for name in names(line)}
    for name, n in places.items():
        if source.text.count(name) <= 1:
            yield Finding(n, message=f"Remove this unused private field '{name}'.")


# Repeats of an earlier line's key


def repeat_rule(key: str, pattern: str, each: bool = False):
    """A finding where a line's first match, or with ``each`` any match, has a key that was there before."""

    compiled = from_word(pattern)

    def check(source):
        first: dict[str, int] = {}
        keys = captured(compiled)
        for n, line, trimmed in source.numbered():
            for name in keys(line):
                if name in first:
                    yield Finding(n, message=f"'{name}' was on line {first[name]} already.", snippet=trimmed)
                else:
                    first[name] = n
                if not each:
                    break

    RULES[key] = gated(pattern, check)
    needs(key, compiled, alone=True)


repeat_rule("CodeSmell:S3047", r"for\s*\([^)]+:\s*(\w+)\s*\)")
repeat_rule("CodeSmell:S3959", r"(\w+)\.stream\(\)", each=True)
repeat_rule("CodeSmell:S5967", r"void\s+(\w+)\s*\(")


# Counts over a file


@kept
def _literals(line: str) -> list[str]:
    return re.findall(r'"([^"]{4,})"', line)


@rule("CodeSmell:S1192")
def repeated_literals(source):
    first: dict[str, int] = {}
    count: Counter = Counter()
    for n, line, _ in source.numbered():
        for text in _literals(line):
            first.setdefault(text, n)
            count[text] += 1
    for text, n in first.items():
        if count[text] >= 3:
            yield Finding(n, message=f"Define a constant instead of repeating this text {count[text]} times.")


@rule("CodeSmell:S1200")
def many_imports(source):
    if sum(line.startswith("import ") for line in source.lines) > 30:
        yield Finding(1)


@rule("CodeSmell:S1479")
def many_cases(source):
    if source.text.count("case ") > 30:
        yield Finding(1)


def class_line(source):
    m = re.search(r"class\s+(\w+)", source.text)
    yield Finding(source.reported_line(m.start()) if m else 1)


@rule("Complexity:S1200")
def coupled_classes(source):
    if source.text.count("import") > 20 and re.search(r"class\s+(\w+)", source.text) and len(set(re.findall(r"import\s+[\w.]+\.(\w+)\s*;", source.text))) > 20:
        yield from class_line(source)


@rule("Complexity:S1448")
def many_methods(source):
    if source.text.count("(") <= 35 or source.text.count("{") <= 35:  # each match has one of its own
        return
    methods = re.findall(r"(?:public|private|protected)\s+(?:static\s+)?(?:\w+)\s+\w+\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{", source.text)
    if re.search(r"class\s+(\w+)", source.text) and len(methods) > 35:
        yield from class_line(source)


@rule("Complexity:S1820")
def many_fields(source):
    if sum(map(source.text.count, ("private", "protected", "public"))) <= 20:
        return
    fields = re.findall(r"(?:private|protected|public)\s+(?:static\s+)?(?:final\s+)?(?:\w+)\s+\w+\s*[=;]", source.text)
    if re.search(r"class\s+(\w+)", source.text) and len(fields) > 20:
        yield from class_line(source)


@rule("Complexity:S104")
def long_file(source):
    if len(source.lines) > 1000:
        yield Finding(1)


# Patterns over the whole file


def holds(pattern: str) -> Callable[[SourceFile], object]:
    compiled = re.compile(pattern)
    return lambda source: compiled.search(source.text)


EMPTY_BLOCK = re.compile(r"\{\s*+\}")


def around_empty_blocks(source: SourceFile) -> tuple[int, int]:
    """The part of a text that has all matches with at most one ``)`` and an empty block at their ends; an empty one if none."""
    ends = [m.span() for m in EMPTY_BLOCK.finditer(source.text)]
    if not ends:
        return 0, 0
    at = source.text.rfind(")", 0, ends[0][0])
    return source.text.rfind(")", 0, max(0, at)) + 1, ends[-1][1]


def file_pattern(key: str, pattern: str, wrong: Callable[[re.Match, SourceFile], bool] = lambda m, s: True, shown: bool = False, maybe: Callable[[SourceFile], object] = lambda s: True, end: str = "", within: Callable[[SourceFile], tuple[int, int]] | None = None):
    """``maybe`` is a quick test that holds for each file with a finding; ``end`` is a match's end, as :func:`ended` has it.

    ``within`` gives the part of the text that all matches are in, for a pattern that doesn't look beyond its match.
    """
    compiled, end = re.compile(pattern), end and re.compile(end)

    def check(source):
        if not maybe(source):
            return
        for m in ended(source.text, compiled, end, source.heads) if end else compiled.finditer(source.text, *within(source) if within else ()):
            if wrong(m, source):
                yield Finding(source.reported_line(m.start()), snippet=m[0].strip() if shown else None)

    RULES[key] = gated(pattern, check)


file_pattern("Bug:S2689", r"@Override[\s\n]*public\s+boolean\s+equals\s*\(\s*(\w+)", lambda m, s: m[1] != "Object")
file_pattern("CodeSmell:S3923", r"if\s*\([^)]+\)\s*\{\s*(\w+)\s*\}\s*else\s*\{\s*(\w+)\s*\}", lambda m, s: m[1] == m[2], maybe=holds(r"\}\s*+else\s*+\{"))
file_pattern("CodeSmell:S107", r"(?:public|private|protected)\s+(?:static\s+)?(?:\w+)\s+(\w+)\s*\(([^)]*)\)", lambda m, s: bool(m[2].strip()) and len(m[2].split(",")) > s.limits.params, maybe=lambda s: s.text.count(",") >= s.limits.params)
file_pattern("CodeSmell:S108", r"(?:if|else|for|while|try|catch|finally|switch)\s*(?:\([^)]*\))?\s*\{\s*\}", shown=True, within=around_empty_blocks)
file_pattern("CodeSmell:S1066", r"if\s*\([^)]+\)\s*\{\s*\n\s*if\s*\(", maybe=holds(r"\)\s*+\{\s*+if\s*+\("))
file_pattern("CodeSmell:S1186", r"(?:public|private|protected)\s+(?:static\s+)?(?:\w+)\s+(\w+)\s*\([^)]*\)\s*\{\s*\}", end=r"\)\s*+\{\s*+\}")


# Methods, cut out by their braces


@lru_cache(maxsize=None)
def _named(pattern: re.Pattern) -> Callable[[str], tuple[int, str] | None]:
    """A function that finds a pattern's first match in a part of a text, as its place and first group; made where it is used."""

    def named(part: str) -> tuple[int, str] | None:
        m = pattern.search(part)
        return m and (m.start(), m[1])

    return kept(named)


def methods(source: SourceFile, pattern: re.Pattern = METHOD, end: re.Pattern = METHOD_END) -> list[tuple[int, str, str]]:
    """Place, name and body of the methods whose heads match, found once for a file and pattern.

    Before a head stands one of ``;{})`` or nothing, so it is looked for in a text of its own, which is kept if it comes again.
    """
    known = source.__dict__.setdefault("methods", {})
    if pattern not in known:
        text, named, out = source.text, _named(pattern), []
        for start, close in source.heads:
            if (m := end.match(text, close)) and (found := named(text[start : m.end()])):
                if (body := source.body_from(start + found[0])) is not None:
                    out.append((start + found[0], found[1], body))
        known[pattern] = out
    return known[pattern]


@kept
def cognitive_score(body: str) -> int:
    """Score by the starts of lines; a structure costs one more for each level that it is nested in."""
    score = level = 0
    for line in split_lines(body):
        flat, nests, closes = _scored(line)
        score += flat + nests * level
        level = max(0, level + nests - closes)
    return score


@kept
def _scored(line: str) -> tuple[int, int, int]:
    """Of a line: its score outside of any structure, 1 if a structure begins on it, and the levels that it closes."""
    line = line.strip()
    nests = not line.startswith("else") and ((line.startswith(("if", "for", "while")) and "(" in line) or line.startswith(("do", "switch", "try")))
    flat = nests or line.startswith(("else", "catch", "finally"))
    return flat + line.count("&&") + line.count("||") + line.count("?"), int(nests), max(0, line.count("}") - line.count("{"))


@rule("Complexity:S3776")
def cognitive_complexity(source):
    for at, name, body in methods(source):
        if (score := cognitive_score(body)) > source.limits.complexity:
            yield Finding(source.reported_line(at), message=f"Cognitive complexity of '{name}' is {score}.")


@kept
def _decisions(body: str) -> int:
    """The decisions in a method's body; none where it has less than ten words of them, of which each decision has one."""
    return 0 if sum(map(body.count, DECISION_WORDS)) < 10 else sum(len(re.findall(p, body)) for p in DECISIONS)


@rule("Complexity:S1541")
def cyclomatic_complexity(source):
    for at, name, body in methods(source):
        if (score := _decisions(body) + 1) > 10:
            yield Finding(source.reported_line(at), message=f"Cyclomatic complexity of '{name}' is {score}.")


@rule("Complexity:S138")
def long_method(source):
    for at, name, body in methods(source):
        if body.count("\n") >= 100 and (count := len(split_lines(body))) > 100:
            yield Finding(source.reported_line(at), message=f"Method '{name}' has {count} lines.")


VISIBLE_METHOD, PLAIN_END = re.compile(r"(?:public|private|protected)\s+\w+\s+(\w+)\s*\([^)]*\)\s*\{"), re.compile(r"\)\s*+\{")


@rule("Bug:S2190")
def endless_recursion(source):
    for at, name, body in methods(source, VISIBLE_METHOD, PLAIN_END):
        if name not in body or "if" in body or "?" in body:
            continue
        code = [t for t in map(str.strip, split_lines(body)) if t and not t.startswith("//")]
        if len(code) <= 3 and re.search(rf"\b{re.escape(name)}\s*\(", body):
            yield Finding(source.reported_line(at), message=f"'{name}' calls itself without end.")


# What a line needs, for the rules that are written out above

for _key, _pattern in {
    "CodeSmell:S4165": from_word(r"(\w+)\s*=\s*(\w+)\s*;"),
    "Naming:S115": r"(static\s+final|final\s+static)\s+\w+\s+(\w+)",
    "Naming:S116": r"private\s+(\w+)\s+(\w+)\s*[;=]",
    "Bug:S2275": r'(?:printf|format)\s*\(\s*"([^"]*)"(?:\s*,\s*([^)]+))?\)',
    "CodeSmell:S109": r"[=<>+\-*/]\s*(\d{2,})[^dDfFlL]",
    "CodeSmell:S1104": r"public\s+(\w+)\s+(\w+)\s*[;=]",
    "Bug:S2201": rf"^\s*\w+\.\s*({'|'.join(PURE_METHODS)})\s*\([^)]*\)\s*;",
    "CodeSmell:S1694": r"abstract\s+class\s+(\w+)",
    "CodeSmell:S5958": r"class\s+(\w+)",
    "Security:S2095": f"new (?:{'|'.join(TRY_RESOURCES)})",
    "Bug:S2095": rf"new\s+({'|'.join(CLOSED_RESOURCES)})\s*\(",
    "Bug:S2272": r"next\(\)",
    "Bug:S2699": "@Test",
    "Bug:S5413": r"for \(",
    "Bug:S1751": r"\b(for|while)\s*\([^)]*\)\s*\{",
    "CodeSmell:S1488": from_word(r"(\w+)\s+(\w+)\s*=\s*[^;]+;"),
    "Bug:S1862": r"(?:if|else\s+if)\s*\(([^)]+)\)",
    "Bug:S1850": from_word(r"(\w+)\s+instanceof\s+(\w+)"),
    "Bug:S4973": COMPARED,
    "CodeSmell:S1144": r"private\s+(?:static\s+)?(?:final\s+)?(?:\w+)\s+(\w+)\s*[;=]",
    "CodeSmell:S1192": r'"([^"]{4,})"',
    "CodeSmell:S1151": "case |default:",
    "Complexity:S1151": r"^\s*(?:case |default:)",
}.items():
    needs(_key, _pattern, alone=True)

#: Besides its own pattern, those of the other lines that make a difference to a rule; none given: all lines do.
for _key, (_pattern, *_also) in {
    "Bug:S2276": (r"\.wait\s*\(", r"while\s*\(", BRACE, r"if[ (]"),
    "CodeSmell:S6301": ("@Test",),
    "Bug:S2273": (r"\.\s*(wait|notify|notifyAll)\s*\(", "synchronized", "}"),
    "Bug:S1226": (r"(?:public|private|protected)\s+\w+\s+\w+\s*\(([^)]+)\)", BRACE, r"^\s*\w+\s*=\s*[^=]"),
    "CodeSmell:S1226": (r"(?:public|private|protected)[^{]+\(\s*(?:final\s+)?(\w+)\s+(\w+)", "="),
    "CodeSmell:S1165": (r"class\s+\w*Exception", r"(?:private|protected|public)\s+(\w+)\s+\w+", "}"),
    "CodeSmell:S1219": ("switch", r"^\s*\w+\s*:", "}"),
    "CodeSmell:S1223": (r"(?:public|private|protected)\s+(\w+)\s+(\w+)\s*\(", r"class\s+(\w+)"),
    "CodeSmell:S1700": (r"(?:private|public|protected)\s+(?:static\s+)?\w+\s+(\w+)\s*[=;]", r"class\s+(\w+)"),
    "CodeSmell:S134": (r"^\s*(?:if|for|while|switch|try)[ (]", "}"),
    "CodeSmell:S128": (r"^\s*case ",),
    "Bug:S2696": (r"(?:public|private|protected)\s+\w+\s+\w+\s*\([^)]*\)\s*\{", BRACE, r"=|\+\+|--"),
}.items():
    needs(_key, _pattern, also=tuple(_also))

SERIAL |= {"Bug:S2276", "Bug:S2273", "Bug:S1226", "CodeSmell:S1226", "CodeSmell:S1165", "CodeSmell:S1219", "CodeSmell:S1223", "CodeSmell:S1700", "CodeSmell:S134", "Bug:S1862", "CodeSmell:S1192"}
PURE |= {"CodeSmell:S4165", "Naming:S115", "Naming:S116", "Bug:S2275", "CodeSmell:S109", "CodeSmell:S1104", "Bug:S2201"}


@kept
def line_findings(line: str) -> list[tuple[str, Finding]]:
    """The findings of the rules in :data:`PURE` on a line, with their keys, as if it were a file's first."""
    source = SourceFile("", "")
    source.text, source.lines = line, [line]
    bits = line_bits(line)
    return [(key, f) for key in sorted(PURE) if bits & NEEDS[key][1] for f in RULES[key](source)]


@lru_cache(maxsize=None)
def series_findings(key: str, limits: Limits) -> Callable[[tuple[str, ...]], list[Finding]]:
    """A function that gives the findings of a rule in :data:`SERIAL` on lines, as if they were a file's; made where it is used."""

    def found(lines: tuple[str, ...]) -> list[Finding]:
        source = SourceFile("", "", limits)
        source.text, source.lines = "\n".join(lines), list(lines)
        return list(RULES[key](source))

    known = lru_cache(maxsize=KEPT_SERIES)(found)
    return lambda lines: known(lines) if sum(map(len, lines)) <= KEPT_CHARS else found(lines)


def moved(finding: Finding, line: int) -> Finding:
    """A finding on a file's first line, on another one."""
    edit = finding.edit and (line, finding.edit[1], line, *finding.edit[3:])
    return finding._replace(line=line, edit=edit)


def line_of(source: SourceFile, at: int) -> int:
    """True line of a place in the text."""
    return bisect_right(source._feeds, at - 1) + 1
