"""Line and file predicates: one notation, two SQL dialects.

``line`` is a line of a file, ``src`` its whole text.  Notation::

    line~NAME          a named pattern matches        line∋"text"       the text occurs
    src~NAME           likewise in the whole file     src∋"text"
    ltrim starts "//"  the trimmed line starts so     ltrim ends ";"
    NOT x   x AND y   x OR y   ( )                    names bound by ``where a := x; b := y``
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r'\s*(?:(?P<op>AND\b|OR\b|NOT\b|\(|\))|(?P<has>(?:line|src)∋"(?:[^"\\]|\\.)*")|(?P<like>(?:line|src)~(?:\w+))|(?P<trim>ltrim (?:starts|ends) "[^"]*")|(?P<name>\w+))')


class NotAPredicate(ValueError):
    """The text isn't in the notation."""


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple = ()
    subject: str = ""
    text: str = ""


@dataclass
class Predicate:
    root: Node
    facts: dict[str, Node] = field(default_factory=dict)

    def sql(self, dialect: Dialect) -> str:
        return dialect.render(self.root)


def _unescape(text: str) -> str:
    return text.replace('\\"', '"').replace("\\\\", "\\")


def parse(text: str, patterns: dict[str, str]) -> Node:
    """Tree of a predicate; ``patterns`` has the named patterns."""
    body, _, where = text.partition("; where ")
    names: dict[str, Node] = {}
    for part in filter(None, (p.strip() for p in re.split(r"; (?=\w+ :=)", where))):
        name, _, definition = part.partition(" := ")
        names[name.strip()] = _Parser(definition, patterns, names).whole()
    return _Parser(body, patterns, names).whole()


class _Parser:
    def __init__(self, text: str, patterns: dict[str, str], names: dict[str, Node]):
        self.patterns, self.names, self.tokens = patterns, names, []
        at, text = 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise NotAPredicate(text[at:])
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self) -> Node:
        node = self._any()
        if self.at != len(self.tokens):
            raise NotAPredicate(str(self.tokens[self.at :]))
        return node

    def _next(self, value: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == ("op", value):
            self.at += 1
            return True
        return False

    def _any(self) -> Node:
        parts = [self._all()]
        while self._next("OR"):
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def _all(self) -> Node:
        parts = [self._one()]
        while self._next("AND"):
            parts.append(self._one())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def _one(self) -> Node:
        if self._next("NOT"):
            return Node("not", (self._one(),))
        if self._next("("):
            node = self._any()
            if not self._next(")"):
                raise NotAPredicate("a bracket is open")
            return node
        if self.at == len(self.tokens):
            raise NotAPredicate("something is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "has":
            subject, _, text = value.partition("∋")
            return Node("has", subject=subject, text=_unescape(text[1:-1]))
        if kind == "like" and value.partition("~")[2] in self.patterns:
            subject, _, name = value.partition("~")
            return Node("like", subject=subject, text=self.patterns[name])
        if kind == "trim":
            m = re.match(r'ltrim (starts|ends) "(.*)"', value)
            return Node(m[1], text=m[2])
        if kind == "name" and value in self.names:
            return self.names[value]
        raise NotAPredicate(value)


#: Pieces that are looked for instead of one, at most.
MOST_PIECES = 16


def needed_pieces(pattern: str) -> tuple[list[str], bool]:
    """Pieces of text of which every match holds at least one, and whether case doesn't matter; [] if none is sure."""
    parser = re._parser
    try:
        tree = parser.parse(pattern)
    except re.error:
        return [], False
    ignore = bool(tree.state.flags & re.IGNORECASE)
    found = _pieces(tree)
    return sorted({p.lower() for p in found} if ignore else set(found)), ignore


def _pieces(items) -> list[str]:
    """The best set of pieces that a sequence needs: the longest shortest piece."""
    sets: list[list[str]] = []
    run: list[str] = []

    def end():
        if run:
            sets.append(["".join(run)])
            run.clear()

    def walk(part):
        for op, arg in part:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(arg))
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
            else:
                end()
                if name == "BRANCH":
                    options = [_pieces(option) for option in arg[1]]
                    if all(options) and sum(map(len, options)) <= MOST_PIECES:
                        sets.append([p for option in options for p in option])
                elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1 and (inner := _pieces(arg[2])):
                    sets.append(inner)
                elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                    sets.append([chr(c) for _, c in arg])

    walk(items)
    end()
    return max(sets, key=lambda pieces: (min(map(len, pieces)), -len(pieces)), default=[])


def node_pieces(node: Node) -> tuple[list[str], bool]:
    """Pieces of which every line that the predicate holds on has at least one, and whether in lower case; [] if unknown."""
    if node.kind == "like" and node.subject == "line":
        return needed_pieces(node.text)
    if node.kind == "has" and node.subject == "line" or node.kind in ("starts", "ends"):
        return [node.text], False
    if node.kind == "and":
        found = [x for x in map(node_pieces, node.parts) if x[0]]
        return max(found, key=lambda x: (-len(x[0]), min(map(len, x[0]))), default=([], False))
    if node.kind == "or":
        found = [node_pieces(p) for p in node.parts]
        if all(pieces for pieces, _ in found) and len({ignore for _, ignore in found}) == 1:
            return sorted({p for pieces, _ in found for p in pieces}), found[0][1]
    return [], False


class Dialect:
    """SQL of nodes over columns ``text``, ``trimmed`` and ``src``."""

    columns = {"line": "text", "src": "src"}

    def render(self, node: Node) -> str:
        if node.kind in ("and", "or"):
            return "(" + f" {node.kind.upper()} ".join(self.render(p) for p in node.parts) + ")"
        if node.kind == "not":
            return f"(NOT {self.render(node.parts[0])})"
        return self.leaf(node)

    def leaf(self, node: Node) -> str:
        raise NotImplementedError

    def text(self, value: str) -> str:
        raise NotImplementedError


class SparkDialect(Dialect):
    """With ``facts``, what is known of the whole file is a column of its own, named after the place in ``facts``."""

    def __init__(self, facts: list[Node] | None = None):
        self.facts = facts

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def leaf(self, node: Node) -> str:
        if node.subject == "src" and self.facts is not None:
            if node not in self.facts:
                self.facts.append(node)
            return f"fact_{self.facts.index(node)}"
        column = self.columns.get(node.subject)
        if node.kind == "has":
            return f"contains({column}, {self.text(node.text)})"
        if node.kind == "like":
            return self.matches(column, node.text)
        return f"{'startswith' if node.kind == 'starts' else 'endswith'}(trimmed, {self.text(node.text)})"

    def matches(self, column: str, pattern: str) -> str:
        """A search with Unicode classes; a plain one for what every match needs goes first.

        Letters of either case can be matched by others than their lower case, so text that isn't ASCII is searched at once.
        """
        pieces, ignore = needed_pieces(pattern)
        # whether there is a match, its first word's last letter tells; a long word isn't gone through once for each letter
        pattern = re.sub(r"^(\(?)\\w\+", r"\1\\w", pattern)
        found = f"{column} rlike {self.text('(?U)' + pattern)}"
        if not pieces:
            return found
        where = column if not ignore else "lowered" if column == "text" else f"lower({column})"
        wide = [] if not ignore else ["wide" if column == "text" else "src_wide"]
        return f"(({' OR '.join([*wide, *(f'contains({where}, {self.text(p)})' for p in pieces)])}) AND {found})"


class DuckDialect(Dialect):
    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def leaf(self, node: Node) -> str:
        column = self.columns.get(node.subject)
        if node.kind == "has":
            return f"contains({column}, {self.text(node.text)})"
        if node.kind == "like":
            return f"regexp_matches({column}, {self.text(node.text)})"
        return f"{'starts_with' if node.kind == 'starts' else 'ends_with'}(trimmed, {self.text(node.text)})"
