"""Rules that compare what a pattern captures, count in a line, or count in a file, as SQL expressions.

They need more than a predicate can say, but no state: a line has as many findings as its expression tells, all of them of
the whole line, and a file has one or none.  So they stand beside the predicates in the one pass in the JVM.  Each is also a
function in :mod:`fathom.operators.source_rules`, by which the two are tested against each other.
"""

from __future__ import annotations

from typing import NamedTuple

from fathom.functions.predicates import SparkDialect
from fathom.operators.source_rules import COMMENTED_CODE, PRIMITIVES

_D = SparkDialect()


class Counted(NamedTuple):
    """SQL of the number of findings on a line, where ``where`` holds; ``needed`` is a pattern that every such line matches."""

    where: str
    count: str = "1"
    needed: str | None = None


def _text(value: str) -> str:
    return _D.text(value)


def _pattern(pattern: str) -> str:
    """As SQL, with Unicode classes; one that begins with a word begins where a word does."""
    return _text("(?U)" + (r"(?<!\w)" if pattern.startswith((r"(\w+)", r"\w+")) else "") + pattern)


def each(pattern: str, groups: tuple[int, ...], wrong: str) -> Counted:
    """The matches of which two or three groups, ``{a}``, ``{b}`` and ``{c}`` in their order, are wrong."""
    found = [f"regexp_extract_all(text, {_pattern(pattern)}, {n})" for n in groups]
    if len(groups) == 2:
        tests = f"zip_with({found[0]}, {found[1]}, (a, b) -> {wrong.format(a='a', b='b')})"
    else:
        tests = f"zip_with(zip_with({found[0]}, {found[1]}, (a, b) -> struct(a as a, b as b)), {found[2]}, (x, c) -> {wrong.format(a='x.a', b='x.b', c='c')})"
    return Counted(_D.matches("text", pattern), f"size(filter({tests}, w -> w))", pattern)


def first(pattern: str, wrong: str, *also: str) -> Counted:
    """Lines whose first match has wrong groups; ``{1}`` stands for a group."""
    groups = [f"regexp_extract(text, {_pattern(pattern)}, {n})" for n in range(10)]
    return Counted(" AND ".join([*also, _D.matches("text", pattern), f"({wrong.format(*groups)})"]), needed=pattern)


def line(pattern: str, *also: str) -> Counted:
    return Counted(" AND ".join([*also, _D.matches("text", pattern)]), needed=pattern)


def times(text: str, of: str = "text") -> str:
    return f"((length({of}) - length(replace({of}, {_text(text)}, ''))) div {len(text)})"


def _outside(pattern: str, least: int, most: int) -> str:
    number = f"coalesce(try_cast(x as decimal(38,0)), {most + 1})"
    return f"size(filter(regexp_extract_all(text, {_pattern(pattern)}, 1), x -> {number} < {least} OR {number} > {most}))"


def _any(*texts: str, of: str = "text") -> str:
    return "(" + " OR ".join(f"contains({of}, {_text(t)})" for t in texts) + ")"


# Patterns, names and limits, as the definitions have them.
_OPERATORS = r"(\w+)\s*(==|!=|&&|\|\||<=|>=|<|>|\+|-|\*|/|%|\^|&|\|)\s*(\w+)"
_COST, _MONTH, _DAY = r"cost\s*[=:]\s*(\d+)", r"Calendar\.MONTH\s*,\s*(\d+)", r"Calendar\.DAY_OF_MONTH\s*,\s*(\d+)"
_SQL_CALL, _SQL_TEXT = r"(executeQuery|executeUpdate|execute|prepareStatement)\s*\([^)]*\+", r'".*?(SELECT|INSERT|UPDATE|DELETE|WHERE).*?"\s*\+'
_MISSPELLED = [r"\b(int|Integer)\s+hashcode\s*\(", r"\bString\s+tostring\s*\(", r"\bboolean\s+equal\s*\("]
_ZERO = r"\b\w+\s*\*\s*0\b|\b0\s*\*\s*\w+\b"

ON_LINES: dict[str, Counted] = {
    "Bug:S1201": first(r"boolean\s+equals\s*\(\s*(\w+)\s+\w+\s*\)", "{1} <> 'Object'"),
    "Bug:S2121": first(r"public\s+boolean\s+equals\s*\(\s*(\w+)\s+\w+\s*\)", "{1} <> 'Object'"),
    "Bug:S1656": each(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*;", (1, 2), "{a} = {b}"),
    "Bug:S1764": each(_OPERATORS, (1, 2, 3), "{a} = {c} AND {b} NOT IN ('+', '*') AND NOT ({a} = 'null' AND {b} IN ('==', '!='))"),
    "Bug:S2114": each(r"(\w+)\.(addAll|removeAll|containsAll|retainAll)\s*\(\s*(\w+)\s*\)", (1, 3), "{a} = {b}"),
    "Bug:S2251": first(r"for\s*\([^;]+;\s*(\w+)\s*(<|>|<=|>=)\s*[^;]+;\s*(\w+)(--|\+\+|-)", "{1} = {3} AND startswith({2}, '<') = ({4} <> '++')"),
    "CodeSmell:S1164": first(r"catch\s*\(\s*(\w+)\s+(\w+)\s*\)\s*\{\s*throw\s+(\w+)\s*;", "{2} = {3}"),
    "CodeSmell:S1170": first(r"public\s+static\s+final\s+(\w+)", "{1} <> 'class'", "NOT startswith(trimmed, '//')"),
    "CodeSmell:S2176": first(r"class\s+(\w+)\s+extends\s+\w+\s+implements\s+(.+)", "contains({2}, {1})"),
    "CodeSmell:S3077": first(r"volatile\s+(\w+)\s+\w+", f"{{1}} NOT IN ({', '.join(map(_text, sorted(PRIMITIVES)))})"),
    "CodeSmell:S4165": first(r"(\w+)\s*=\s*(\w+)\s*;", "{1} = {2}"),
    "Security:S5344": first(_COST, "coalesce(try_cast({1} as decimal(38,0)), 10) < 10", _any("BCrypt", "PBKDF2", "Argon2"), _any("cost", "iterations")),
    "Bug:S2110": Counted("contains(text, 'Calendar.')", f"{_outside(_MONTH, 0, 11)} + {_outside(_DAY, 1, 31)}", r"Calendar\."),
    "Bug:S2185": Counted(f"({_D.matches('text', _ZERO)} OR text rlike '[/%-]' AND exists(zip_with(regexp_extract_all(text, {_text(r'(?U)\b(\w+)\s*([/\-%])\s*(\w+)\b')}, 1), regexp_extract_all(text, {_text(r'(?U)\b(\w+)\s*([/\-%])\s*(\w+)\b')}, 3), (a, b) -> a = b), w -> w))"),
    "CodeSmell:S2178": line(r"\s+([&|])\s+", "NOT contains(text, '&&')", "NOT contains(text, '||')"),
    "Security:S3649": Counted(f"({_D.matches('text', _SQL_CALL)} OR contains(text, '+') AND upper(text) rlike {_text('(?U)' + _SQL_TEXT)})"),
    "Security:S6293": Counted(f"contains(text, 'Pattern.compile') AND {times('+')} + {times('*')} + {times('?')} > 5", needed=r"Pattern\.compile"),
    "Bug:S1221": Counted("NOT contains(text, '@Override') AND " + _any("hashcode", "tostring", "equal", of="lowered"), " + ".join(f"cast(lowered rlike {_text('(?U)' + p)} as int)" for p in _MISSPELLED)),
    "CodeSmell:S125": Counted("(" + " OR ".join(_D.matches("text", p) for p in COMMENTED_CODE) + ")"),
    "Complexity:S1067": Counted(f"{times('&&')} + {times('||')} > 3"),
}

#: On a file, by its text ``src`` and its lines ``cut``; a finding on line 1.
ON_FILES: dict[str, str] = {
    "CodeSmell:S1210": f"{_any('boolean equals(Object', 'boolean equals(java.lang.Object', of='src')} <> contains(src, 'int hashCode()')",
    "CodeSmell:S1220": f"NOT exists(cut, t -> contains(t, 'package ') AND t rlike {_text(r'(?U)^\s*package ')})",
    "CodeSmell:S1451": "NOT exists(slice(cut, 1, 10), t -> contains(t, 'Copyright') OR contains(t, 'copyright'))",
    "CodeSmell:S110": rf"size(regexp_extract_all(src, {_text(r'(?U)class\s+\w+\s+extends\s+\w+')}, 0)) > 5",
    "CodeSmell:S1118": rf"contains(src, 'static') AND NOT contains(src, 'new ') AND src rlike {_text(r'(?U)public\s+\w+\s*\(\s*\)')}",
    "CodeSmell:S1479": f"{times('case ', 'src')} > 30",
    "CodeSmell:S1200": "size(filter(cut, t -> startswith(t, 'import '))) > 30",
    "Complexity:S104": "size(cut) > 1000",
}
KEYS = frozenset(ON_LINES) | frozenset(ON_FILES)
