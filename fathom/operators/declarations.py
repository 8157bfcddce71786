"""What a source declares: types, methods and fields with their modifiers and surroundings, imports and string literals."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathom.functions.text import lines
from fathom.operators.java_syntax import Scanner

# Modifiers in the order in which they are told, and the patterns of imports and of string literals.
TOLD = ("public", "private", "protected", "static", "final", "abstract", "synchronized", "volatile", "transient", "native")
IMPORT = r"import\s+([\w.]+(?:\.\*)?)\s*;"
STRING = r'"(?:[^"\\]++|\\.)*+"'

DECLARED = "path string, kind string, name string, modifiers array<string>, parameters array<string>, line int, enclosing_class string, enclosing_method string"


def modifiers_of(text: str) -> list[str]:
    """Modifiers that a declaration's beginning holds, in the order in which they are told."""
    return [m for m in TOLD if m in text]


class Members(Scanner):
    """Declarations with the range of tokens that each takes: ``(kind, name, modifiers, parameters, at, first, last)``."""

    def __init__(self, text: str):
        self.members: list[tuple] = []
        super().__init__(text)

    def _modifiers(self, i: int) -> list[str]:
        """Modifiers in what stands between the declaration at ``i`` and the one before; annotations' text counts as well."""
        start = i
        while start > 0 and self.t[start - 1].text not in (";", "{", "}"):
            start -= 1
        return modifiers_of(" ".join(t.text for t in self.t[start:i]))

    def _parameters_of(self, i: int, end: int) -> list[str]:
        """Names of the parameters in the brackets from ``i`` on; a variable number of arguments isn't one."""
        out, depth, name, spread = [], 0, None, False
        for token in self.t[i:end]:
            opened = token.text in ("(", "<", "[")
            depth += opened
            if depth == 1 and token.text in (",", ")"):
                if name and not spread:
                    out.append(name)
                name, spread = None, False
            elif depth == 1 and token.kind == "word":
                name = token.text
            spread = spread or token.text == "..."
            depth -= token.text in (")", ">", "]")
        return out

    def _type(self, i: int, stop: int) -> int:
        place = len(self.members)
        self.members.append(())
        end = super()._type(i, stop)
        self.members[place] = (self.t[i].text, self.t[i + 1].text, self._modifiers(i), [], self.t[i].at, i, end)
        return end

    def _member(self, i: int, stop: int) -> int:
        place, start = len(self.members), i
        self.members.append(())
        end = super()._member(i, stop)
        i = max(self.angles(i), i + 1) if self._is(i, "<") else i
        while i < stop and self.t[i].text not in ("(", "=", ";", "{", "}", ","):
            i = max(self.angles(i), i + 1)
        # the last word before, without the brackets of an array
        name = next((k for k in range(min(i, stop) - 1, start - 1, -1) if self.t[k].kind == "word"), None)
        if name is None or i >= stop or self.t[i].text in ("{", "}"):
            del self.members[place]
            return end
        if self._is(i, "("):
            typed = name > start and (self.t[name - 1].kind == "word" or self.t[name - 1].text in (">", "]"))
            kind, parameters = ("method" if typed else "constructor"), self._parameters_of(i, self.close(i, stop))
        else:
            kind, parameters = "field", []
        self.members[place] = (kind, self.t[name].text, self._modifiers(start), parameters, self.t[start].at, start, end)
        return end


def declared(path: str, src: str) -> list[tuple]:
    """Rows of :func:`declarations` of one file, in order of place."""
    feeds = [n for n, c in enumerate(src) if c == "\n"]
    members = Members(src).members
    out, open_ = [], []
    for kind, name, modifiers, parameters, at, first, last in sorted(members, key=lambda m: (m[5], -m[6])):
        while open_ and open_[-1][2] <= first:
            open_.pop()
        around = lambda kinds: next((n for k, n, _ in reversed(open_) if k in kinds), None)
        out.append((path, kind, name, modifiers, parameters, bisect_right(feeds, at) + 1, around(("class",)), around(("method", "constructor"))))
        open_.append((kind, name, last))
    return out


def declarations(files: DataFrame) -> DataFrame:
    """``(path, kind, name, modifiers, parameters, line, enclosing_class, enclosing_method)`` of every file's declarations.

    Kinds are class, interface, enum, record, method, constructor and field.  ``enclosing_class`` is the innermost class
    around a declaration and ``enclosing_method`` the innermost method or constructor, null without one; so what has one is
    in a method's body.  The line is that of the declaration behind its modifiers.  Files that couldn't be read have none.
    """
    schema = T._parse_datatype_string(DECLARED)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [r for path, src in zip(part["path"].to_pylist(), part["src"].to_pylist()) if src is not None for r in declared(path, src)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(map(list, zip(*rows)), arrow)], schema=arrow)

    return files.select("path", "src").mapInArrow(run, schema)


def class_info(files: DataFrame) -> DataFrame:
    """``(path, name, modifiers, line, methods, fields)`` of every class, with the names of the methods and fields in it."""
    rows = declarations(files)
    classes = rows.where("kind = 'class'").select("path", "name", "modifiers", "line")
    own = rows.where("kind in ('method', 'field') and enclosing_class is not null").groupBy("path", F.col("enclosing_class").alias("name"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("line", rows["name"].alias("n"))))), lambda x: x["n"])
    members = own.agg(listed("method").alias("methods"), listed("field").alias("fields"))
    empty = F.array().cast("array<string>")
    return classes.join(members, ["path", "name"], "left").select("path", "name", "modifiers", "line", F.coalesce("methods", empty).alias("methods"), F.coalesce("fields", empty).alias("fields"))


def import_list(src: Column) -> Column:
    """Names of the imported classes and packages, in order."""
    return F.regexp_extract_all(src, F.lit(IMPORT), F.lit(1))


def imports(files: DataFrame) -> DataFrame:
    """``(path, name)`` of every import."""
    return files.select("path", F.explode(import_list(F.col("src"))).alias("name"))


def uses_import(src: Column, text: str) -> Column:
    """Whether the name of any import holds a text."""
    return F.exists(import_list(src), lambda name: name.contains(text))


def string_literals(files: DataFrame) -> DataFrame:
    """``(path, line, literal)`` of every string, with its quotes."""
    cut = files.select("path", F.posexplode(lines(F.col("src"))).alias("at", "text")).where(F.col("text").contains('"'))
    return cut.select("path", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(STRING), F.lit(0))).alias("literal"))
