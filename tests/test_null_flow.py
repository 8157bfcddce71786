"""Null flow against all paths of random programs, and files that are nested as programs write them."""

import random
import time

import pytest

from fathom.operators import java_syntax
from fathom.operators.source_rules import RULES, SourceFile

NAMES = ("a", "b", "c")


def statements(rng, depth, budget):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["use", "use", "set", "null", "copy"] + ["if", "ifelse", "while", "for", "try", "block", "return"] * (depth > 0 and budget[0] > 0))
        if kind in ("if", "ifelse", "while", "for", "try", "block"):
            budget[0] -= 1
        v, w = rng.choice(NAMES), rng.choice(NAMES)
        body = lambda: statements(rng, depth - 1, budget)
        if kind in ("use", "set", "null", "return"):
            out.append((kind, v))
        elif kind == "copy":
            out.append((kind, v, w))
        elif kind in ("if", "while"):
            out.append((kind, v, rng.choice(["==", "!="]), body()))
        elif kind == "ifelse":
            out.append((kind, v, rng.choice(["==", "!="]), body(), body()))
        else:
            out.append((kind, body()))
    return out


def text_of(program, lines):
    for kind, *s in program:
        if kind == "use":
            s.append(None)
            lines.append(f"{s[0]}.go();")
        elif kind in ("set", "null"):
            lines.append(f"{s[0]} = {'null' if kind == 'null' else 'new X()'};")
        elif kind == "copy":
            lines.append(f"{s[0]} = {s[1]};")
        elif kind == "return":
            lines.append("return;")
        else:
            head = {"if": "if ({0} {1} null) {{", "ifelse": "if (null {1} {0}) {{", "while": "while ({0} {1} null) {{", "for": "for (;;) {{", "try": "try {{", "block": "{{"}[kind]
            lines.append(head.format(*s[:2]))
            if kind == "ifelse":
                text_of(s[2], lines)
                lines.append("} else {")
            text_of(s[-1], lines)
            lines.append("} catch (E e) { a.go(); }" if kind == "try" else "}")
    return lines


def paths(program, states, at, seen):
    """All states behind a program that paths reach, one by one; ``at`` counts lines, ``seen`` has the values at each use."""
    alive = states
    for kind, *s in program:
        at[0] += 1
        here = at[0]
        if kind == "use":
            for state in alive:
                seen.setdefault((here, s[0]), set()).add(dict(state).get(s[0]))
        elif kind in ("set", "null", "copy"):
            value = {"set": lambda d: "set", "null": lambda d: "null", "copy": lambda d: d.get(s[1])}[kind]
            alive = {frozenset((dict(state) | {s[0]: value(dict(state))}).items()) for state in alive}
        elif kind == "return":
            alive = set()
        elif kind in ("if", "ifelse"):
            yes, no = refined(alive, s[0], s[1], True), refined(alive, s[0], s[1], False)
            if kind == "ifelse":
                yes = paths(s[2], yes, at, seen)
                at[0] += 1
                no = paths(s[3], no, at, seen)
            else:
                yes = paths(s[2], yes, at, seen)
            at[0] += 1
            alive = yes | no
        elif kind in ("while", "for"):
            start, reached = at[0], set(alive)
            while True:
                at[0] = start
                inner = refined(reached, s[0], s[1], True) if kind == "while" else reached
                more = reached | paths(s[-1], inner, at, seen)
                if more == reached:
                    break
                reached = more
            at[0] += 1
            alive = refined(reached, s[0], s[1], False) if kind == "while" else reached
        else:
            inside = paths(s[0], alive, at, seen)
            at[0] += 1
            alive = alive | inside if kind == "try" else inside
    return alive


def refined(states, name, sign, holds):
    """A condition is taken to tell the variable's value on each path, whatever was known."""
    return {frozenset((dict(state) | {name: "null" if (sign == "==") == holds else "set"}).items()) for state in states}


def count_lines(program):
    return len(text_of(program, []))


def found(lines):
    source = SourceFile("A", "class A { void f() {\n" + "\n".join(lines) + "\n} }\n")
    return {(f.line - 1, lines[f.line - 2].split(".")[0]): f.severity for f in RULES["Bug:S2259"](source)}


def without_dead(program):
    """Statements behind a return aren't looked at, so they are left out."""
    out = []
    for s in program:
        out.append(tuple(without_dead(p) if isinstance(p, list) else p for p in s))
        if not goes_on(s):
            break
    return out


def goes_on(s):
    ends = lambda p: not all(goes_on(x) for x in p)
    return not (s[0] == "return" or s[0] == "block" and ends(s[1]) or s[0] == "ifelse" and ends(s[3]) and ends(s[4]))


@pytest.mark.parametrize("seed", range(8))
def test_against_all_paths(seed):
    rng = random.Random(seed)
    uses = 0
    for _ in range(120):
        program = without_dead(statements(rng, 4, [7]))
        lines, seen = text_of(program, []), {}
        paths(program, {frozenset()}, [0], seen)
        want = {key: "blocker" if values == {"null"} else "major" for key, values in seen.items() if values != {"set"}}
        assert found(lines) == want, "\n".join(lines)
        uses += len(seen)
    assert uses > 100


def timed(text, key="Bug:S2259"):
    began = time.perf_counter()
    out = list(RULES[key](SourceFile("A", text)))
    assert time.perf_counter() - began < 20
    return out


DEEP = 100_000


@pytest.mark.parametrize(
    "opening, closing",
    [("{", "}"), ("if (s == null) {", "}"), ("if (s == null) { a(); } else ", ""), ("while (s != null) {", "}"), ("if (s != null)\n", ""), ("try {", "} finally { }"), ("x(() -> {", "});"), ("int v = f(new X() { int g() {", "} });")],
)
def test_deep_statements(opening, closing):
    text = "class A { void f(String s) {\n" + opening * DEEP + "\ns = null; s.go();\n" + closing * DEEP + "\n} }"
    if "while" not in opening:
        timed(text)
    else:
        timed(text.replace(opening * DEEP, opening * 3000).replace(closing * DEEP, closing * 3000))


@pytest.mark.parametrize("opening, closing", [("class B_b {", "}"), ("class C { void F_f() { new X() {", "} } }"), ("@A(", ")"), ("List<", ">"), ("int f(", ")"), ("enum E { A; ", "}")])
def test_deep_types(opening, closing):
    for key in ("Naming:S100", "Naming:S101", "Naming:S117"):
        timed(opening * (DEEP // 2) + closing * (DEEP // 2), key)
    scanner = java_syntax.Scanner("class B_b {" * 5000 + "}" * 5000)
    assert len(scanner.found) == 5000


def test_nested_loops():
    text = "class A { void f(String a, String b, String c) {\n" + "while (a != null) { for (;;) {" * 20 + "\nc.go(); c = b; b = a; a = null;\n" + "} }" * 20 + "\n} }"
    assert [(f.line, f.severity) for f in timed(text)] == [(3, "major")]


def test_long_method():
    lines = [f"s{n % 50} = null; s{n % 50}.go();" for n in range(4000)]
    assert len(timed("class A { void f() {\n" + "\n".join(lines) + "\n} }")) == 4000
