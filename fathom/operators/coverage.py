"""Line coverage from trace files and XML reports, read line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.folders import checkpointed

#: Lines of a numbered report that one task goes through in order.
BLOCK_LINES = 1 << 16


def _last_records(text: DataFrame, form: dict[str, Column], numbers: int | None = None, repeated: bool = False) -> DataFrame:
    """``(file, line, hits)`` of each file's last record in its report; a file without lines has a row of nulls.

    ``text(source, at, ...)`` are the lines of reports; ``at`` is unique in a report and orders it, in blocks of ``numbers``.
    With a column ``block`` it only orders a block's lines, and ``block`` orders the blocks.  ``form`` tells what a line is:
    ``opens`` where it may open a file, ``opened`` the file's name, or empty where it closes one, ``line`` and ``hits`` where
    it counts a line of code; all other lines are passed over.

    The last record of a file is found among the lines that open one.  What is open where a block starts, and what the next
    one starts with, come from a table with a row a block, so a long report isn't one task's.  Only the blocks that hold
    lines of last records are gone through, each by itself; their table is broadcast (at most a row a block), so other
    lines are read but never sent.  With ``repeated``, rows that are alike in all columns count once; as the tables above
    are the same with and without copies, they go where the blocks are gone through.
    """
    numbered = "block" not in text.columns
    block = F.expr(f"at div {numbers or BLOCK_LINES}") if numbered else F.col("block")
    opening = text.where(form["opens"]).select("source", block.alias("block"), "at", form["opened"].alias("file")).where("file <> ''").groupBy("source", "file")
    heads = (opening.agg(F.max("at").alias("at")) if numbered else opening.agg(F.max(F.struct("block", "at")).alias("last")).select("source", "file", "last.*")).select("source", "file", block.alias("block"), F.col("at").alias("record"))
    kinds = text.select("source", block.alias("block"), "at", form["opened"].alias("opened"), form["line"].isNotNull().alias("counts"))
    mark = F.when(F.col("opened").isNotNull(), F.col("at"))
    blocks = kinds.groupBy("source", "block").agg(F.max(mark).alias("last"), F.max(F.when(F.col("opened") != "", F.col("at"))).alias("named"), F.min(mark).alias("first"), F.min(F.when(F.col("counts"), F.col("at"))).alias("line"))
    blocks = blocks.where("last is not null or line is not null").select("source", "block", F.expr("if(last = named, last, if(last is null, null, -1))").alias("end"), F.expr("coalesce(line < first, line is not null)").alias("starts"))
    along = Window.partitionBy("source").orderBy("block")
    edges = blocks.select("source", "block", F.last("end", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.lead("starts").over(along).alias("follows"))
    holding = heads.select("source", "block", F.lit(True).alias("holds")).distinct()
    going_on = heads.select("source", F.col("record").alias("carried"), F.lit(True).alias("goes_on")).distinct()
    edges = edges.join(holding, ["source", "block"], "left").join(going_on, ["source", "carried"], "left").where("holds or goes_on").select("source", "block", "carried", "follows")
    near = text.withColumn("block", block).join(F.broadcast(edges), ["source", "block"])
    near = near.distinct() if repeated else near
    # What is told by an exploded column is told after the join, and once for a line
    said = F.explode(F.array(F.struct(form["opened"].alias("opened"), form["line"].alias("line"), form["hits"].alias("hits"))))
    rows = near.select("source", "block", "at", "carried", "follows", said.alias("said")).select("*", "said.*").where("opened is not null or line is not null")
    within = Window.partitionBy("source", "block").orderBy("at")
    mark = F.when(F.col("opened") == "", F.lit(-1)).when(F.col("opened").isNotNull(), F.col("at"))
    record = F.coalesce(F.last(mark, True).over(within), "carried").alias("record")
    lined = F.coalesce(F.lead(F.col("line").isNotNull()).over(within), "follows", F.lit(False)).alias("lined")
    placed = rows.select("source", "opened", "line", "hits", record, lined).where("line is not null or opened <> '' and not lined")
    return placed.join(heads.select("source", "file", "record"), ["source", "record"]).select("file", "line", "hits")


def _lcov() -> dict[str, Column]:
    value = F.trim("value")
    opens = value.startswith("SF:")
    opened = F.when(opens, F.substring(value, F.lit(4), F.length(value))).when(value == "end_of_record", F.lit(""))
    counts = value.startswith("DA:") & value.rlike(r"^DA:\+?[0-9]+,\+?[0-9]+(,|$)")
    numbers = F.substring(value, F.lit(4), F.length(value))
    hits = F.substring_index(F.substring_index(numbers, ",", 2), ",", -1)
    many = F.least(hits.try_cast("decimal(38,0)").cast("double"), F.lit(2.0**62)).cast("long")
    return {"opens": opens, "opened": opened, "line": F.when(counts, F.substring_index(numbers, ",", 1).try_cast("long")), "hits": F.when(counts, many)}


def lcov_lines(text: DataFrame, numbers: int | None = None, repeated: bool = False) -> DataFrame:
    """``(file, line, hits)`` of ``text(source, at, value)``: the trace's lines with their order.

    ``SF:`` opens a file, ``end_of_record`` or the next one closes it, branch records are skipped, and so are lines whose
    numbers aren't whole and positive.  Of a file that occurs twice in a trace the last record counts, with its lines only;
    one without lines has a row of nulls.  Where lines' numbers have gaps, ``numbers`` is how far a block of them reaches;
    with ``repeated``, rows that are alike in all columns, these and others, count once.
    """
    return _last_records(text, _lcov(), numbers, repeated)


def _jacoco() -> dict[str, Column]:
    value = F.trim("value")
    opens = value.contains("<sourcefile")
    opened = F.when(opens & value.rlike(r'name="[^"]*"'), F.regexp_extract(value, r'name="([^"]*)"', 1))
    number = lambda c: F.coalesce(F.regexp_extract(value, rf'{c}="\+?([0-9]+)"', 1).try_cast("long"), F.lit(0))
    counts = value.contains("<line") & value.contains("nr=") & (number("nr") > 0)
    return {"opens": opens, "opened": opened, "line": F.when(counts, number("nr")), "hits": F.when(counts, number("ci"))}


def jacoco_lines(text: DataFrame) -> DataFrame:
    """``(file, line, hits)`` of an XML report, one element a line; hits are covered instructions, files have bare names.

    A file's lines are those up to the next ``sourcefile``; a line without a number above 0 is skipped, and one without
    instructions counts as not covered.  Files that repeat or have no lines are as in :func:`lcov_lines`.
    """
    return _last_records(text, _jacoco())


def report_lines(spark, path: str) -> DataFrame:
    """``(source, block, at, value)`` of the lines of a report, which is read in splits.

    A block is what one split holds of one file, by its place in it; the lines of a block are in order of ``at``.  The
    numbers aren't the same in every pass over the file, since splits follow the cores that there are, so what is made of
    them has to be written once.
    """
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read_coverage(spark, path: str) -> DataFrame:
    """Coverage of one report; its form is told by the path's ending, or else by what it holds.

    The report is read in splits, however long it is.  The lines that say something are kept as numbers in the shared folder.
    """
    text = report_lines(spark, path)
    low = path.lower()
    xml = low.endswith(".xml")
    if not low.endswith((".xml", ".info", ".lcov")):
        tag = F.col("value").contains("<report") | (F.ltrim("value").startswith("<?xml") & (F.col("at") == 0))
        form = text.agg(F.bool_or(tag).alias("xml"), F.bool_or(F.col("value").contains("SF:")).alias("trace")).first()
        xml = bool(form.xml)
        if not xml and not form.trace:
            raise ValueError(f"{path}: neither a trace nor an XML report")
    form = _jacoco() if xml else _lcov()
    told = ("opened", "line", "hits")
    rows = text.select("source", "block", "at", *(form[c].alias(c) for c in told)).where("opened is not null or line is not null")
    return _last_records(checkpointed(rows), {c: F.col(c) for c in told} | {"opens": F.col("opened") != ""})


def _share() -> Column:
    whole = F.col("covered") + F.col("uncovered")
    return F.when(whole > 0, F.col("covered") * 100.0 / whole).otherwise(0.0)


def file_coverage(covered: DataFrame) -> DataFrame:
    """``(file, covered, uncovered, percentage)``; 0 per cent without lines."""
    counts = covered.groupBy("file").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count_if(F.col("hits") <= 0).alias("uncovered"))
    return counts.withColumn("percentage", _share())


def below(covered: DataFrame, threshold: float) -> DataFrame:
    """Files strictly below a threshold."""
    return file_coverage(covered).where(F.col("percentage") < threshold)


def total_coverage(covered: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row: lines, share, and whether it reaches the threshold."""
    counts = covered.agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count_if(F.col("hits") <= 0).alias("uncovered"))
    return counts.withColumn("percentage", _share()).withColumn("passed", F.col("percentage") >= threshold)


def uncovered(covered: DataFrame, file: str | None = None) -> DataFrame:
    """Lines that nothing ran, of one file or of all."""
    rows = covered.where("hits <= 0").select("file", "line")
    return rows.where(F.col("file") == file) if file else rows


def uncovered_below(covered: DataFrame, threshold: float) -> DataFrame:
    """Lines that nothing ran, of the files strictly below a threshold; ``covered`` is gone through once, a file at a time."""
    of_file = Window.partitionBy("file")
    counts = covered.select("file", "line", "hits", F.count_if(F.col("hits") > 0).over(of_file).alias("covered"), F.count_if(F.col("hits") <= 0).over(of_file).alias("uncovered"))
    return uncovered(counts.where(_share() < threshold))
