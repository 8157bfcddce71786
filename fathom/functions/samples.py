"""Shortest strings that a pattern matches: the generated corpus is made of these."""

from __future__ import annotations

import re

_PARSER = re._parser
#: Stand-ins for classes, in the order in which they are tried.
CHARS = "aA1_ .(){};,=+-*/<>\"'!?&|@#:[]x\\%^~$`\t"
CLASSES = {"CATEGORY_WORD": "a", "CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " ", "CATEGORY_NOT_SPACE": "a", "CATEGORY_NOT_WORD": "(", "CATEGORY_NOT_DIGIT": "a"}


def sample(pattern: str) -> str | None:
    """A string in which the pattern is found, on one line and without non-ASCII characters; None if none was made."""
    try:
        tree = _PARSER.parse(pattern)
    except re.error:
        return None
    for pick in range(3):
        text = _walk(tree, pick, {})
        for before, after in (("", ""), (" ", " "), ("x ", ";"), (" ", "a "), ("", " a")):
            if "\n" not in text and re.search(pattern, before + text + after):
                return before + text + after
    return None


def _one_of(items) -> str:
    if str(items[0][0]) == "NEGATE":
        return next(c for c in CHARS if not any(_has(i, c) for i in items[1:]))
    op, arg = items[0]
    name = str(op)
    return chr(arg) if name == "LITERAL" else chr(arg[0]) if name == "RANGE" else CLASSES[str(arg)]


def _has(item, char: str) -> bool:
    name, arg = str(item[0]), item[1]
    if name == "LITERAL":
        return chr(arg) == char
    if name == "RANGE":
        return arg[0] <= ord(char) <= arg[1]
    return bool(re.match({"CATEGORY_WORD": r"\w", "CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": r"\s"}.get(str(arg), r"\S"), char))


def _walk(items, pick: int, groups: dict) -> str:
    out = []
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "NOT_LITERAL":
            out.append(next(c for c in CHARS if c != chr(arg)))
        elif name == "ANY":
            out.append("a")
        elif name == "IN":
            out.append(_one_of(arg))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, part = arg
            times = least if pick == 0 else min(most, max(least, pick))
            out.append(_walk(part, pick, groups) * times)
        elif name == "SUBPATTERN":
            out.append(_walk(arg[3], pick, groups))
        elif name == "BRANCH":
            out.append(_walk(arg[1][pick % len(arg[1])], pick, groups))
        elif name == "CATEGORY":
            out.append(CLASSES[str(arg)])
    return "".join(out)
