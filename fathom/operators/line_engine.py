"""Rules that judge a line by itself, or with facts of its whole file, each different line once.

The different lines of all files are a table of their own, with the rules that hold on each; the files' lines are looked up in
it.  Facts (is a word anywhere in the file?) are computed once for a file and travel as booleans; a rule that needs some is
judged for all values that they can have, and the file's own values pick among these.  The catalogue is a bounded table and
is joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.folders import checkpointed
from fathom.functions.predicates import Node, SparkDialect, needed_pieces, node_pieces
from fathom.functions.text import lines, trim
from fathom.operators.counted_rules import ON_FILES, ON_LINES, Counted
from fathom.operators.file_pass import EDIT, FINDING
from fathom.operators.suppression import mark_ids
from fathom.sources.catalog import Rule, load

#: Predicates in one generated expression; more would pass the size that the JVM compiles.
CHUNK = 75
#: Characters of a text that rules share, and rules that it stands for at most.
GATE_CHARS, GATED = 3, 12
#: Bytes up to which the judged lines are sent to every task, and what a row of them takes besides its text.
SENT_BYTES, ROW_BYTES = 32 << 20, 100


def line_rules(rules: Iterable[Rule] | None = None) -> list[Rule]:
    """Rules with a predicate on lines, or on lines and files."""
    return [r for r in (load() if rules is None else rules) if r.kind in ("MAC", "LINE", "GATE") and r.predicate() is not None]


def file_predicates(rules: Iterable[Rule] | None = None) -> list[Rule]:
    """Rules with a predicate on the whole file."""
    return [r for r in (load() if rules is None else rules) if r.kind == "FILE" and r.predicate() is not None]


def file_lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(path, line, text, lowered, trimmed, wide)`` and the columns in ``keep`` of every line of ``files(path, src)``."""
    cut = files.select("path", *(keep or []), F.posexplode(F.transform(lines(F.col("src")), lambda t: F.struct(*_facets(t)))).alias("at", "of"))
    return cut.select("path", (F.col("at") + 1).alias("line"), "of.text", "of.lowered", "of.trimmed", "of.wide", *(keep or []))


def _facets(t: Column) -> list[Column]:
    # made in the array, before it is exploded: as columns of a later projection they would be copied into every predicate
    return [t.alias("text"), F.lower(t).alias("lowered"), trim(t).alias("trimmed"), t.rlike(r"[^\x00-\x7f]").alias("wide")]


def _around(at: Column) -> Column:
    """:func:`fathom.operators.file_pass.context_hash` of the line at an index of ``cut``, by the lines in ``bare``."""
    text = F.concat_ws("\n", *[F.when(at + step >= 0, F.get("bare", at + step)) for step in (-1, 0, 1)])
    return F.when(at < F.size("cut"), F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)"))


def _joined(parts: list[str]) -> str:
    return f"concat_ws(',', {', '.join(parts)})"


def _names(predicates: list[tuple[int, str]]) -> str:
    """SQL: the ordinals of the predicates that hold, joined to a string.

    That is an expression that the JVM gets as many small compiled methods; an array function would be interpreted.
    """
    parts = [f"if({sql}, '{n}', null)" for n, sql in predicates]
    return _joined([_joined(parts[at : at + CHUNK]) for at in range(0, len(parts), CHUNK)])


def shared_pieces(pieces: dict[int, tuple[str, bool]]) -> list[tuple[str, bool, list[int]]]:
    """Short texts that several of the pieces hold, each with the numbers of those pieces that it stands for.

    Taken greedily: the text that stands for the most pieces that have none yet, up to ``GATED`` of them.
    """
    holders: dict[tuple[str, bool], set[int]] = {}
    for n, (piece, ignore) in pieces.items():
        for at in range(len(piece) - GATE_CHARS + 1):
            holders.setdefault((piece[at : at + GATE_CHARS], ignore), set()).add(n)
    out, left = [], set(pieces)
    for (text, ignore), _ in sorted(holders.items(), key=lambda x: (-len(x[1]), x[0])):
        while len(mine := sorted(holders[text, ignore] & left)) > 1:
            out.append((text, ignore, mine[:GATED]))
            left -= set(mine[:GATED])
    return out


def _repeated(ordinal: int, rule: Counted) -> str:
    """SQL: the ordinal as often as a counted rule has findings, joined; null if it has none."""
    if rule.count == "1":
        return f"if({rule.where}, '{ordinal}', null)"
    return f"if({rule.where}, array_join(array_repeat('{ordinal}', {rule.count}), ','), null)"


class _Known(SparkDialect):
    """With the values of what is known of the file."""

    def __init__(self, values: dict[Node, bool]):
        super().__init__()
        self.values = values

    def leaf(self, node: Node) -> str:
        return str(self.values[node]).lower() if node in self.values else super().leaf(node)


def _given(rule: Rule, dialect: SparkDialect) -> str:
    """SQL: the ordinal if the rule holds on a line, once for all values of the facts it needs, with what these then are."""
    facts = SparkDialect(facts=[])
    sql = facts.render(rule.predicate())
    if not facts.facts:
        return f"if({sql}, '{rule.ordinal}', null)"
    dialect.render(rule.predicate())
    numbers = [2 * dialect.facts.index(node) for node in facts.facts]
    parts = []
    for values in product((False, True), repeat=len(numbers)):
        sql = _Known(dict(zip(facts.facts, values))).render(rule.predicate())
        parts.append(f"if({sql}, '{':'.join(map(str, [rule.ordinal, *(n + v for n, v in zip(numbers, values))]))}', null)")
    return _joined(parts)


def _line_names(rules: list[Rule], dialect: SparkDialect, counted: list[Rule] = ()) -> str:
    """SQL: the ordinals of the rules that hold on a line.

    Rules whose every match needs a piece of text are tried where a part of it is found, which several rules share, so most
    of them cost a line nothing.  Lines with other than ASCII letters are tried on all.
    """
    held = {r.ordinal: _given(r, dialect) for r in rules}
    needed = {r.ordinal: node_pieces(r.predicate()) for r in rules}
    held |= {r.ordinal: _repeated(r.ordinal, ON_LINES[r.key]) for r in counted}
    needed |= {r.ordinal: needed_pieces(ON_LINES[r.key].needed) for r in counted if ON_LINES[r.key].needed}
    gates = shared_pieces({n: (pieces[0], ignore) for n, (pieces, ignore) in needed.items() if len(pieces) == 1})
    parts = [f"if(wide or contains({'lowered' if ignore else 'text'}, {dialect.text(text)}), {_joined([held.pop(n) for n in mine])}, null)" for text, ignore, mine in gates]
    parts += held.values()
    return _joined([_joined(parts[at : at + CHUNK]) for at in range(0, len(parts), CHUNK)]) if parts else "''"


def judged_lines(texts: DataFrame, names: str, marks: bool) -> DataFrame:
    """``(text, trimmed, ids, rule_ord, given)`` of the different lines ``texts(text)`` and of each rule that holds on one.

    A line is judged once, however often it stands in the files.  ``given`` has what must be known of a line's file: twice
    a fact's number, and one more if the fact must hold; null if nothing.  ``ids`` is the line's mark if ``marks``.  The table
    is written once, and sent to the tasks that look lines up in it unless it is large; else lines are joined by a shuffle.
    """
    context = texts.sparkSession.sparkContext
    texts = texts.distinct().repartition(2 * context.defaultParallelism, "text")
    faced = texts.select(F.explode(F.array(F.struct(*_facets(F.col("text"))))).alias("of")).select("of.*")
    ids = mark_ids(F.col("text")) if marks else F.lit(None).cast("array<string>")
    # a function that isn't compiled takes this projection out of whole-stage compilation, whose one method would be too long
    text = F.expr("element_at(transform(array(text), t -> t), 1)").alias("text")
    held = faced.select(text, "trimmed", ids.alias("ids"), F.expr(names).alias("hits"))
    # an outer explode keeps the optimiser from testing the array's size, by making it twice
    held = held.select("text", "trimmed", "ids", F.explode_outer(F.filter(F.split("hits", ",+"), lambda n: n != "")).alias("n")).where("n is not null")
    told = F.transform(F.split("n", ":"), lambda n: n.cast("int"))
    given = F.when(F.size(told) > 1, F.slice(told, 2, F.size(told) - 1))
    found = checkpointed(held.select("text", "trimmed", "ids", F.get(told, F.lit(0)).alias("rule_ord"), given.alias("given")))
    size = found.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    return F.broadcast(found) if size <= SENT_BYTES else found


def all_hits(files: DataFrame, rules: list[Rule], on_files: list[Rule] = (), found: Column | None = None, marks: bool = False, keep: list[str] = (), context: bool = False, counted: list[Rule] = ()) -> DataFrame:
    """The hits of predicates on lines and on files, of the rules in ``counted``, and the findings in ``found``, of ``files(path, src)``.

    Rows are ``path``, the columns in ``keep`` of the file, and those of a finding.  Predicates on files are hits on line 1
    without a text.
    ``ids`` is the mark of a predicate's line if ``marks``; findings were compared with it.  With ``context``,
    ``context_hash`` is of the lines around.  A file that couldn't be read has no hits.
    """
    dialect = SparkDialect(facts=[])
    lined = [r for r in counted if r.key in ON_LINES]
    names = _line_names(rules, dialect, lined)
    plain, on_files, keep = SparkDialect(), list(on_files), list(keep)
    of_files = [(r.ordinal, plain.render(r.predicate())) for r in on_files] + [(r.ordinal, ON_FILES[r.key]) for r in counted if r.key in ON_FILES]
    files = files.where("src is not null").withColumn("cut", lines(F.col("src")))
    if context:
        files = files.withColumn("bare", F.transform("cut", trim))
    if dialect.facts or of_files:
        files = files.withColumn("src_wide", F.col("src").rlike(r"[^\x00-\x7f]"))
    none = lambda kind: F.lit(None).cast(kind)
    around = lambda at: _around(at) if context else none("decimal(20,0)")
    of_line = lambda line, trimmed, n, ids, hashed: [line.alias("line"), F.lit(1).alias("column"), none("int").alias("end_column"), none("string").alias("message"), trimmed.alias("trimmed"), none("string").alias("severity"), none(EDIT).alias("edit"), n.cast("int").alias("rule_ord"), ids.alias("ids"), hashed.alias("context_hash")]
    out = []
    if of_files or found is not None:
        of_file = [(F.expr(_names(of_files)) if of_files else F.lit("")).alias("names"), (found if found is not None else none(f"array<{FINDING}>")).alias("found")]
        ids = mark_ids(F.get("cut", F.lit(0))) if marks else none("array<string>")
        heads = files.select("path", *keep, *of_file, ids.alias("ids"), around(F.lit(0)).alias("around"))
        hit = lambda n: F.struct(*of_line(F.lit(1), none("string"), n, F.col("ids"), F.col("around")))
        every = F.concat(F.transform(F.filter(F.split("names", ",+"), lambda n: n != ""), hit), F.coalesce("found", F.array().cast(f"array<{FINDING}>")))
        out.append(heads.select("path", *keep, F.explode_outer(every).alias("hit")).where("hit is not null").select("path", *keep, "hit.*"))
    if rules or lined:
        judged = judged_lines(files.select(F.explode_outer("cut").alias("text")).where("text is not null"), names, marks)
        known = F.array(*[F.expr(plain.render(node)) for node in dialect.facts]).cast("array<boolean>")
        # facts in a projection of their own: beside the explode they would be computed for each line
        rows = files.select("path", *keep, "cut", *["bare"] * context, known.alias("known"))
        if context:
            rows = rows.select("path", *keep, "known", F.posexplode_outer(F.transform("cut", lambda t, at: F.struct(t.alias("text"), around(at).alias("around")))).alias("at", "of"))
            rows = rows.select("path", *keep, "known", (F.col("at") + 1).alias("at"), "of.text", "of.around")
        else:
            rows = rows.select("path", *keep, "known", F.posexplode_outer("cut").alias("at", "text")).select("path", *keep, "known", (F.col("at") + 1).alias("at"), "text", around(None).alias("around"))
        rows = rows.join(judged, "text")
        rows = rows.where("given is null or forall(given, g -> known[g div 2] = (g % 2 = 1))")
        out.append(rows.select("path", *keep, *of_line(F.col("at"), F.col("trimmed"), F.col("rule_ord"), F.col("ids"), F.col("around"))))
    if not out:
        empty = F.array().cast(f"array<{FINDING}>")
        return files.select("path", *keep, F.explode(empty).alias("hit")).select("path", *keep, "hit.*")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def line_hits(files: DataFrame, rules: list[Rule], marks: bool = False, on_files: list[Rule] = ()) -> DataFrame:
    """``(path, line, trimmed, rule_ord)`` of every line and rule that holds on it; with ``marks``, ``ids`` of the line's mark.

    Rules ``on_files`` are found in the same pass, as hits on line 1 without a text; a file that couldn't be read has none.
    """
    return all_hits(files, rules, on_files, marks=marks).select("path", "line", "trimmed", *["ids"] * marks, "rule_ord")


def file_hits(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(path, line, trimmed, rule_ord)``: line 1 of every file on which a rule holds."""
    return line_hits(files, [], on_files=rules)
