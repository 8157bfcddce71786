"""The rules of :mod:`fathom.operators.source_rules` and :mod:`java_syntax`, and custom patterns, as passes over files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

import fathom.operators.java_syntax  # noqa: F401  registers its rules
from fathom.functions.text import split_lines
from fathom.operators.suppression import line_mark
from fathom.operators.source_rules import ALONE, ALSO, NEEDS, PURE, RULES, SERIAL, Finding, Limits, SomeLines, SourceFile, bits_of, byte_column, line_findings, moved, series_findings
from fathom.sources.catalog import Rule

EDIT = "struct<start_line: int, start_column: int, end_line: int, end_column: int, replacement: string>"
FOUND = f"path string, line int, column int, end_column int, message string, trimmed string, severity string, edit {EDIT}, rule_ord int"
#: A finding beside its file; ``ids`` is for marks that are still to be looked at, and null here; ``context_hash`` is of the
#: lines around, where asked for.
FINDING = f"struct<line: int, column: int, end_column: int, message: string, trimmed: string, severity: string, edit: {EDIT}, rule_ord: int, ids: array<string>, context_hash: decimal(20,0)>"
#: Files whose text is turned into Python objects at once.
SLICE_FILES = 64
#: (ordinal, id, pattern, message, negative pattern) of a custom rule.
Custom = tuple[int, str, str, str, str | None]


def source_rules(rules) -> list[Rule]:
    return [r for r in rules if r.key in RULES]


def finder(rules: list[Rule], limits: Limits = Limits(), suppress: bool = False, custom: Iterable[Custom] = ()) -> Callable[[str, str], Iterator[tuple]]:
    """What finds the active rules' and the custom ones' places in a file: a function of path and text that yields
    ``(line, column, end_column, message, trimmed, severity, edit, rule_ord)``."""
    custom, known = list(custom), {r.key: (r.ordinal, r.rule_id) for r in source_rules(rules)}
    # bits that a file must have, and those of the lines that a rule goes through; none: all
    active = [(key, RULES[key], NEEDS[key][1] if key in NEEDS else 0, NEEDS[key][1] | ALSO[key] if key in ALONE else 0) for key in known if key not in PURE]
    pure = sum({NEEDS[key][1] for key in known if key in PURE})

    def places(source: SourceFile) -> Iterator[tuple[str, Finding]]:
        bits, any_ = bits_of(source.lines) if known else [], 0
        for line in set(bits):
            any_ |= line
        if any_ & pure:
            for n, b in enumerate(bits, 1):
                if b & pure:
                    yield from ((key, moved(f, n)) for key, f in line_findings(source.lines[n - 1]) if key in known)
        for key, check, bit, any_of in active:
            if bit and not any_ & bit:
                continue
            if key in SERIAL:
                at = [n for n, b in enumerate(bits) if b & any_of]
                yield from ((key, moved(f, at[f.line - 1] + 1)) for f in series_findings(key, limits)(tuple([source.lines[n] for n in at])))
            else:
                yield from ((key, f) for f in check(SomeLines(source, bits, any_of) if any_of else source))

    def find(path, src):
        source = SourceFile(path, src, limits)
        marked, count = suppress and "NOSONAR" in src, len(source.lines)

        def held(n: int, rule_id: str) -> bool:
            mark = line_mark(source.lines[n - 1]) if marked and 1 <= n <= count else None
            return mark is not None and (not mark or rule_id in mark)

        for key, f in places(source):
            ordinal, rule_id = known[key]
            if marked and held(f.line, rule_id):
                continue
            edit = dict(zip(("start_line", "start_column", "end_line", "end_column", "replacement"), f.edit)) if f.edit else None
            yield f.line, f.column, None, f.message, f.snippet, f.severity, edit, ordinal
        for ordinal, rule_id, pattern, message, negative in custom:
            # the re module keeps compiled patterns
            for number, line, trimmed in source.numbered():
                if negative and re.search(negative, line):
                    continue
                for m in re.finditer(pattern, line):
                    if held(number, rule_id):
                        break
                    yield number, byte_column(line, m.start()), byte_column(line, m.end()), message, trimmed, None, None, ordinal

    return find


def source_hits(files: DataFrame, rules: list[Rule], limits: Limits = Limits(), suppress: bool = False, custom: Iterable[Custom] = ()) -> DataFrame:
    """Findings of the active rules and of custom ones in every file; a file that couldn't be read (null) has none.

    Custom rules have a finding for each match, with byte columns.  Lines that the negative pattern matches are left out;
    comments aren't.  With ``suppress``, findings that their line's mark holds back are left out.
    """
    schema, find = T._parse_datatype_string(FOUND), finder(rules, limits, suppress, custom)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_FILES):
                part = batch.slice(at, SLICE_FILES)
                rows = [(path, *row) for path, src in zip(part["path"].to_pylist(), part["src"].to_pylist()) if src is not None for row in find(path, src)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(map(list, zip(*rows)), arrow)], schema=arrow)

    return files.select("path", "src").mapInArrow(run, schema)


def context_hash(lines: list[str], line: int) -> Decimal | None:
    """Hash of a line, the one before and the one behind, without the blanks around them; none of a line that isn't there."""
    if not 1 <= line <= len(lines):
        return None
    text = "\n".join(t.strip() for t in lines[max(0, line - 2) : line + 1])
    return Decimal(int(md5(text.encode()).hexdigest()[:16], 16))


def findings(rules: list[Rule], limits: Limits = Limits(), suppress: bool = False, custom: Iterable[Custom] = (), context: bool = False) -> Column | None:
    """The findings of :func:`source_hits` as a column of ``files(path, src)``: an array, empty for a file without any.

    So the file's row goes on to whatever else reads its lines.  None if no rule is active.  With ``context``, each has the
    hash of the lines around.
    """
    custom = list(custom)
    if not source_rules(rules) and not custom:
        return None
    kind, find = T.ArrayType(T._parse_datatype_string(FINDING)), finder(rules, limits, suppress, custom)

    def told(path, src):
        lines = split_lines(src) if context else []
        return [(*row, None, context_hash(lines, row[0]) if context else None) for row in find(path, src)]

    @F.arrow_udf(kind)
    def found(path: pa.Array, src: pa.Array) -> pa.Array:
        out, type_ = [], to_arrow_type(kind)
        of = [type_.value_type.field(n) for n in range(type_.value_type.num_fields)]
        for at in range(0, len(path), SLICE_FILES):
            rows, ends = [], [0]
            for p, t in zip(path.slice(at, SLICE_FILES).to_pylist(), src.slice(at, SLICE_FILES).to_pylist()):
                rows += [] if t is None else told(p, t)
                ends.append(len(rows))
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [()] * len(of), of)]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=of), type=type_))
        return pa.concat_arrays(out) if out else pa.array([], type=type_)

    return found("path", "src")


def custom_hits(files: DataFrame, rules: list[tuple[int, str, str, str | None]]) -> DataFrame:
    """Findings of custom rules ``(ordinal, pattern, message, negative pattern)`` alone."""
    return source_hits(files, [], custom=[(n, "", pattern, message, negative) for n, pattern, message, negative in rules])


def with_fix(hits: DataFrame) -> DataFrame:
    """Findings with the columns that an issue has, ``end_line`` and ``fix``, instead of the edit."""
    fix = F.when(F.col("edit").isNotNull(), F.struct(F.concat(F.lit("Rename to "), F.col("edit.replacement")).alias("message"), F.array("edit").alias("edits")))
    return hits.withColumns({"end_line": F.when(F.col("end_column").isNotNull(), F.col("line")), "fix": fix}).drop("edit")
