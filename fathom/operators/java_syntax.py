"""A small scanner of Java declarations and statements, for the rules on names and on null values.

Text is cut into tokens without comments; declarations are recognised by their shape, from the braces around them.  What
can't be parsed is skipped to the next brace or semicolon, so broken files give what their sound parts hold.

Files that programs write can be nested very deeply, so nothing here calls itself: brackets are matched once, bodies wait in
a list, and statements that hold statements are generators that :func:`unrolled` runs on a stack of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Generator, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

from fathom.functions.naming import to_camel_case, to_pascal_case
from fathom.operators.source_rules import CAMEL, PASCAL, Finding, SourceFile, rule

TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"""(?:.*?)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<word>[^\W\d]\w*|\$\w*)|(?P<number>\d[\w.]*)|(?P<mark>->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|\.\.\.|.)', re.S)
TYPE_WORDS = {"class", "interface", "enum", "record"}
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non"}
PRIMITIVE = {"byte", "short", "int", "long", "float", "double", "boolean", "char", "var"}
STATEMENT_WORDS = {"return", "throw", "new", "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "try", "catch", "finally", "assert", "import", "package", "instanceof", "goto", "yield", "this", "super", "synchronized", "static", "void"}
#: Method names that tests may have.
TEST_METHODS = ("main", "setUp", "tearDown")


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class Declaration(NamedTuple):
    kind: str  # class, interface, method, constructor, local, type_parameter, package
    name: str
    at: int
    body: tuple[int, int] = (0, 0)  # tokens of a method's body, braces not included


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start()) for m in TOKEN.finditer(text) if m.lastgroup != "skip"]


def unrolled(call: Generator):
    """The result of a generator that yields calls, of which it is sent the results."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class Scanner:
    def __init__(self, text: str):
        self.t = tokens(text)
        self.found: list[Declaration] = []
        self._match()
        #: What is still to be gone through: members of a type, or a body.
        self.open = [(self._types, 0, len(self.t))]
        while self.open:
            part, i, stop = self.open.pop()
            part(i, stop)
        self.found.sort(key=lambda d: d.at)

    def _match(self) -> None:
        """For each opening bracket and each ``<`` of a list, the token behind the one that closes it."""
        self.closed: dict[int, int] = {}
        self.listed: dict[int, int] = {}
        brackets, angles = [], []
        for i, (_, text, _) in enumerate(self.t):
            if text in ("(", "[", "{"):
                brackets.append(i)
            elif text in (")", "]", "}") and brackets:
                self.closed[brackets.pop()] = i + 1
            if text == "<":
                angles.append(i)
            elif text == ">" and angles:
                self.listed[angles.pop()] = i + 1
            elif text in ("{", "}", ";", "(", "="):
                angles.clear()

    def _is(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text == text

    def close(self, i: int, stop: int | None = None) -> int:
        """Token behind the bracket that closes the opening one at ``i``, or the end."""
        stop = len(self.t) if stop is None else stop
        return min(self.closed.get(i, stop), stop)

    def angles(self, i: int) -> int:
        """Token behind a list in angle brackets at ``i``; ``i`` if there is none."""
        return self.listed.get(i, i)

    def _parameters(self, i: int, end: int) -> None:
        """Names of the type parameters between the angle brackets at ``i``."""
        depth, fresh = 0, False
        for token in self.t[i:end]:
            if token.text == "<":
                depth += 1
                fresh = depth == 1
            elif token.text == ">":
                depth -= 1
            elif token.text == "," and depth == 1:
                fresh = True
            elif fresh and token.kind == "word":
                self.found.append(Declaration("type_parameter", token.text, token.at))
                fresh = False

    def _types(self, i: int, stop: int) -> None:
        """Members of a class body, or of a file."""
        while i < stop:
            word = self.t[i].text
            if word == "@" and not self._is(i + 1, "interface"):
                i += 2
                while self._is(i, "."):
                    i += 2
                i = self.close(i, stop) if self._is(i, "(") else i
            elif word == "package":
                end = next((k for k in range(i, stop) if self.t[k].text == ";"), stop)
                name = "".join(t.text for t in self.t[i + 1 : end])
                if "." in name:  # a single name isn't checked
                    self.found.append(Declaration("package", name, self.t[i].at))
                i = end + 1
            elif word in ("import", ";"):
                i = next((k for k in range(i, stop) if self.t[k].text == ";"), stop) + 1
            elif word in TYPE_WORDS and i + 1 < stop and self.t[i + 1].kind == "word":
                i = self._type(i, stop)
            elif word == "{":
                end = self.close(i, stop)
                self.open.append((self._body, i + 1, end - 1))
                i = end
            elif word in MODIFIERS or self.t[i].kind != "word" and word != "<":
                i += 1
            else:
                i = self._member(i, stop)

    def _type(self, i: int, stop: int) -> int:
        kind, name = self.t[i].text, self.t[i + 1]
        self.found.append(Declaration("interface" if kind == "interface" else kind, name.text, name.at))
        end = self.angles(i + 2)
        self._parameters(i + 2, end)
        while end < stop and self.t[end].text not in ("{", ";"):
            end = self.close(end, stop) if self.t[end].text == "(" else end + 1
        if not self._is(end, "{"):
            return end + 1
        last = self.close(end, stop)
        start = end + 1
        if kind == "enum":  # constants, up to the first semicolon of the body
            while start < last - 1 and self.t[start].text != ";":
                start = self.close(start, last - 1) if self.t[start].text in ("(", "[", "{") else start + 1
            start = min(start + 1, last - 1)
        self.open.append((self._types, start, last - 1))
        return last

    def _member(self, i: int, stop: int) -> int:
        """A method, a constructor or a field from ``i`` on; the token behind it."""
        start = i
        if self._is(i, "<"):
            end = self.angles(i)
            self._parameters(i, end)
            i = max(end, i + 1)
        while i < stop and self.t[i].text not in ("(", "=", ";", "{", "}"):
            i = max(self.angles(i), i + 1)
        if not self._is(i, "("):
            while i < stop and self.t[i].text not in (";", "}"):
                if self.t[i].text in ("{", "(", "["):
                    end = self.close(i, stop)
                    self.open.append((self._body, i + 1, end - 1))
                    i = end
                else:
                    i += 1
            return max(i + 1, start + 1)
        name = self.t[i - 1]
        typed = i - 2 >= start and (self.t[i - 2].kind == "word" or self.t[i - 2].text in (">", "]"))
        end = self.close(i, stop)
        while end < stop and self.t[end].text not in ("{", ";", "}", "="):
            end += 1
        body = (0, 0)
        if self._is(end, "{"):
            last = self.close(end, stop)
            body = (end + 1, last - 1)
            end = last - 1
        if name.kind == "word":
            self.found.append(Declaration("method" if typed else "constructor", name.text, name.at, body))
        self.open.append((self._body, *body))
        return max(end + 1, start + 1)

    def _body(self, i: int, stop: int) -> None:
        """Local variables, and the types declared in expressions and statements."""
        starts = True
        while i < stop:
            word = self.t[i].text
            if word in TYPE_WORDS and i + 1 < stop and self.t[i + 1].kind == "word" and not self._is(i - 1, "."):
                i = self._type(i, stop)
                starts = True
                continue
            if word == "new":  # an anonymous class has its body behind the arguments
                k = i + 1
                while k < stop and (self.t[k].kind == "word" or self.t[k].text == "."):
                    k = max(self.angles(k + 1), k + 1)
                if self._is(k, "("):
                    end = self.close(k, stop)
                    if self._is(end, "{"):
                        last = self.close(end, stop)
                        self.open += [(self._body, k + 1, end - 1), (self._types, end + 1, last - 1)]
                        i, starts = last, False
                        continue
            if starts and (end := self._local(i, stop)):
                i, starts = end, False
                continue
            starts = word in ("{", "}", ";") or (word == "(" and self._is(i - 1, "for")) or (word == "(" and self._is(i - 1, "try")) or (word == "final" and starts)
            i += 1

    def _local(self, i: int, stop: int) -> int:
        """Records ``TYPE NAME = ..., NAME ...;`` at ``i``; the token behind the first name, or 0."""
        k = i
        while self._is(k, "final") or self._is(k, "@"):
            k += 1 if self._is(k, "final") else 2
        if not (k < stop and self.t[k].kind == "word") or self.t[k].text in STATEMENT_WORDS:
            return 0
        k += 1
        while self._is(k, ".") and k + 1 < stop and self.t[k + 1].kind == "word":
            k += 2
        k = self.angles(k)
        while self._is(k, "[") and self._is(k + 1, "]"):
            k += 2
        if not (k < stop and self.t[k].kind == "word") or self.t[k].text in STATEMENT_WORDS:
            return 0
        if not any(self._is(k + 1, end) for end in ("=", ";", ",", "[")):
            return 0
        self.found.append(Declaration("local", self.t[k].text, self.t[k].at))
        at, depth = k + 1, 0
        while at < stop and not (depth == 0 and self.t[at].text == ";"):  # further names of the declaration
            if self.t[at].text in ("(", "[", "{"):
                at = self.close(at, stop)
                continue
            depth += self.t[at].text == "<"
            depth -= self.t[at].text in (")", "}", "]", ">")
            if depth < 0:
                break
            if depth == 0 and self.t[at].text == "," and at + 2 < stop and self.t[at + 1].kind == "word" and self.t[at + 2].text in ("=", ",", ";"):
                self.found.append(Declaration("local", self.t[at + 1].text, self.t[at + 1].at))
            at += 1
        return k + 1


def place(source: SourceFile, at: int) -> tuple[int, int]:
    """Line and byte column of a place."""
    before = bisect_left(source.feeds, at)
    start = source.feeds[before - 1] + 1 if before else 0
    return before + 1, len(source.text[start:at].encode()) + 1


def scan(source: SourceFile) -> Scanner:
    if not hasattr(source, "scanner"):
        source.scanner = Scanner(source.text)
    return source.scanner


def name_rule(key: str, kinds: tuple[str, ...], fits, fix=None):
    def check(source):
        for d in scan(source).found:
            if d.kind in kinds and not fits(d.name):
                line, column = place(source, d.at)
                edit = (line, column, line, column + len(d.name.encode()), fix(d.name)) if fix else None
                yield Finding(line, column, snippet=d.name, edit=edit)

    rule(key)(check)


name_rule("Naming:S100", ("method",), lambda n: re.fullmatch(CAMEL, n) or n in TEST_METHODS or n.startswith("test"), to_camel_case)
name_rule("Naming:S101", ("class",), lambda n: re.fullmatch(PASCAL, n), to_pascal_case)
name_rule("Naming:S114", ("interface",), lambda n: re.fullmatch(PASCAL, n))
name_rule("Naming:S117", ("local",), lambda n: len(n) == 1 or n == "_" or re.fullmatch(CAMEL, n))
name_rule("Naming:S119", ("type_parameter",), lambda n: re.fullmatch(r"[A-Z]|[A-Z][a-zA-Z0-9]*T", n))
name_rule("Naming:S120", ("package",), lambda n: re.fullmatch(r"[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)*", n))

# Null values along a method's paths

NULL, SET, MAYBE = "null", "set", "maybe"
#: What is known of variables: null or set; of one that isn't in it, neither.
State = dict[str, str]
#: A condition's tokens, and whether it holds.
Condition = tuple[int, int, bool]


class NullFlow:
    """Dereferences of values that are or may be null, in the statements of a body.

    The body becomes a graph: a node stands for a simple statement or a place where paths meet, and an edge may say that a
    condition holds or doesn't.  One list of nodes whose state has changed is worked off for the whole body, in the order of
    the text, until nothing changes; states only ever lose what they know, so that ends.  Then each statement is looked at once.
    """

    def __init__(self, scanner: Scanner, start: int, stop: int):
        self.s, self.t = scanner, scanner.t
        self.steps: list[tuple[int, int] | None] = []
        self.edges: list[list[tuple[int, Condition | None]]] = []
        unrolled(self._block(start, stop, self._node()))
        self.states = self._fixpoint()
        self.found = {key: known for n, step in enumerate(self.steps) if step and self.states[n] is not None for key, known in self._dereferenced(*step, self.states[n])}

    def _node(self, *before: tuple[int, Condition | None], step: tuple[int, int] | None = None) -> int:
        self.steps.append(step)
        self.edges.append([])
        for n, condition in before:
            self.edges[n].append((len(self.steps) - 1, condition))
        return len(self.steps) - 1

    # The graph: each part takes the node before it and gives the one behind it, or none if no path gets there

    def _block(self, i: int, stop: int, node: int | None) -> Generator:
        while i < stop and node is not None:
            i, node = yield self._statement(i, stop, node)
        return node

    def _end(self, i: int, stop: int) -> int:
        """Token of the semicolon that ends the statement at ``i``."""
        while i < stop and self.t[i].text != ";":
            i = self.s.close(i, stop) if self.t[i].text in ("(", "[", "{") else i + 1
        return i

    def _after(self, i: int, stop: int, node: int) -> Generator:
        if i < stop and self.t[i].text == "{":
            end = self.s.close(i, stop)
            return end, (yield self._block(i + 1, end - 1, node))
        return (yield self._statement(i, stop, node)) if i < stop else (stop, node)

    def _statement(self, i: int, stop: int, node: int) -> Generator:
        word = self.t[i].text
        if word == "{":
            end = self.s.close(i, stop)
            return end, (yield self._block(i + 1, end - 1, node))
        if word == "if" and self.s._is(i + 1, "("):
            end = self.s.close(i + 1, stop)
            at, then = yield self._after(end, stop, self._node((node, (i + 2, end - 1, True))))
            other = self._node((node, (i + 2, end - 1, False)))
            if at < stop and self.t[at].text == "else":
                at, other = yield self._after(at + 1, stop, other)
            ends = [(n, None) for n in (then, other) if n is not None]
            return at, self._node(*ends) if ends else None
        if word in ("while", "for") and self.s._is(i + 1, "("):
            end = self.s.close(i + 1, stop)
            if word == "for" and self._end(i + 2, end - 1) < end - 1:
                _, first = yield self._statement(i + 2, end - 1, node)
                node = node if first is None else first
            head = self._node((node, None))
            says = lambda holds: (i + 2, end - 1, holds) if word == "while" else None
            at, last = yield self._after(end, stop, self._node((head, says(True))))
            if last is not None:
                self.edges[last].append((head, None))
            return at, self._node((head, says(False)))
        if word == "try":
            at = self.s.close(i + 1, stop) if self.s._is(i + 1, "(") else i + 1
            at, last = yield self._after(at, stop, self._node((node, None)))
            while at < stop and self.t[at].text in ("catch", "finally"):
                at = self.s.close(at + 1, stop) if self.s._is(at + 1, "(") else at + 1
                at = self.s.close(at, stop) if self.s._is(at, "{") else at + 1
            return at, self._node((node, None), *[(last, None)] * (last is not None))
        if word in ("do", "switch", "synchronized", "else", "catch", "finally"):  # not followed
            at = i + 1
            while at < stop and self.t[at].text in ("(", "{"):
                at = self.s.close(at, stop)
            return max(at, i + 1), node
        end = self._end(i, stop)
        if word in ("return", "throw"):
            return end + 1, None
        if word in ("break", "continue"):
            return end + 1, node
        return end + 1, self._node((node, None), step=(i, end))

    # States

    def _fixpoint(self) -> list[State | None]:
        states: list[State | None] = [None] * len(self.steps)
        states[0] = {}
        waiting, listed = [0], {0}
        while waiting:
            n = heappop(waiting)
            listed.discard(n)
            behind = self._behind(n, states[n])
            for target, condition in self.edges[n]:
                new, known = self._refined(behind, condition), states[target]
                # where paths meet, what both know alike stays
                merged = new if known is None else {k: v for k, v in known.items() if new.get(k) == v}
                if known is None or len(merged) < len(known):
                    states[target] = merged
                    if target not in listed:
                        listed.add(target)
                        heappush(waiting, target)
        return states

    def _value(self, i: int, stop: int, state: State) -> str:
        if stop - i == 1:
            token = self.t[i]
            if token.text == "null":
                return NULL
            if token.kind in ("text", "number") or token.text in ("this", "true", "false"):
                return SET
            return state.get(token.text, MAYBE)
        return SET if i < stop and self.t[i].text == "new" else MAYBE

    def _receiver(self, i: int, end: int) -> tuple[int | None, int]:
        """Of a call that is the statement itself, the last dot of the name before its arguments; and where the name ends."""
        k, dot = i, None
        while k < end and (self.t[k].kind == "word" or self.t[k].text == "."):
            dot = k if self.t[k].text == "." else dot
            k += 1
        return dot, k

    def _assigned(self, i: int, end: int) -> int | None:
        """The ``=`` of an assignment to a name."""
        equals = next((k for k in range(i, end) if self.t[k].text == "="), None)
        return equals if equals is not None and equals > i and self.t[equals - 1].kind == "word" else None

    def _behind(self, n: int, state: State) -> State:
        """The state behind a node."""
        if self.steps[n] is None:
            return state
        i, end = self.steps[n]
        name, value = None, MAYBE
        if (equals := self._assigned(i, end)) is not None:
            name, value = self.t[equals - 1].text, self._value(equals + 1, end, state)
        else:
            dot, k = self._receiver(i, end)
            if dot is not None and dot > i and self.s._is(k, "("):
                pass
            elif k == i + 1 and k < end and self.t[k].kind == "word":
                name = self.t[k].text
            elif end - i == 2 and self.t[i + 1].kind == "word":
                name = self.t[i + 1].text
        if name is None or state.get(name, MAYBE) == value:
            return state
        state = {k: v for k, v in state.items() if k != name}
        return state if value == MAYBE else state | {name: value}

    def _dereferenced(self, i: int, end: int, state: State) -> Iterator[tuple[tuple[int, str], str]]:
        if self._assigned(i, end) is None:
            dot, k = self._receiver(i, end)
            if dot is not None and dot > i and self.s._is(k, "("):
                receiver = "".join(t.text for t in self.t[i:dot])
                if receiver not in ("this", "super") and (known := state.get(receiver, MAYBE)) != SET:
                    yield (self.t[i].at, receiver), known

    def _refined(self, state: State, condition: Condition | None) -> State:
        """The state where a condition holds or doesn't."""
        if condition is None:
            return state
        i, stop, holds = condition
        if stop - i == 3 and self.t[i + 1].text in ("==", "!=") and "null" in (self.t[i].text, self.t[i + 2].text):
            name = self.t[i].text if self.t[i + 2].text == "null" else self.t[i + 2].text
            return state | {name: NULL if (self.t[i + 1].text == "==") == holds else SET}
        return state


@rule("Bug:S2259")
def null_dereferences(source):
    scanner = scan(source)
    for d in scanner.found:
        if d.kind in ("method", "constructor") and d.body != (0, 0):
            for (at, name), known in NullFlow(scanner, *d.body).found.items():
                line, column = place(source, at)
                sure = known == NULL
                yield Finding(line, column, message=f"'{name}' {'is' if sure else 'may be'} null here.", snippet=source.lines[line - 1].strip(), severity="blocker" if sure else "major")
