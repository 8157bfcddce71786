"""Re-analysis of changed files: changes of a path are taken together until it has been quiet for a while."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.folders import shared_folder

QUIET = "300 milliseconds"


def watched(changes: DataFrame, extension: str = ".java") -> DataFrame:
    return changes.where(F.col("path").endswith(extension))


def debounced(changes: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """``(path, first, ready, n)`` of each burst of ``changes(path, ts)``: a session window that a pause ends.

    For streams; with the watermark a burst comes out once no change of it can still arrive.
    """
    stream = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return stream.groupBy("path", F.session_window("ts", quiet).alias("burst")).agg(F.count("*").alias("n")).select("path", F.col("burst.start").alias("first"), F.col("burst.end").alias("ready"), "n")


def debounced_batch(changes: DataFrame, quiet_seconds: float) -> DataFrame:
    """The same for a table of changes: a burst starts where the pause before is as long."""
    order = Window.partitionBy("path").orderBy("ts")
    micros = F.unix_micros("ts")
    started = (micros - F.lag(micros).over(order) >= int(quiet_seconds * 1_000_000)).cast("int")
    numbered = changes.withColumn("burst", F.sum(F.coalesce(started, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "burst").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).select("path", "first", "last", "n")


def start(changes: DataFrame, read: Callable[[DataFrame], DataFrame], analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str = "1 second", **options):
    """A running query: for each burst the path's file is read, analysed, and its issues appended to a table.

    ``read`` turns ``(path)`` into ``files(path, src)``.  The batch number is kept with the rows, and a batch that runs
    again after a failure overwrites its own.
    """

    def one(batch: DataFrame, number: int) -> None:
        files = read(batch.select("path").distinct())
        analyse(files).write.mode("overwrite").parquet(f"{out}/batch={number}")

    trigger = options or {"processingTime": every}
    return debounced(watched(changes)).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ready(listing: DataFrame, known: DataFrame, now: float, quiet: float) -> DataFrame:
    """``(path, modified, size)`` of the files that have changed since they were ``known`` and are quiet by ``now``.

    ``listing`` and ``known`` are ``(path, modified, size)`` with times in seconds; files that are gone have nothing to
    be analysed.
    """
    before = known.select("path", F.col("modified").alias("was"), F.col("size").alias("had"))
    same = F.col("modified").eqNullSafe(F.col("was")) & F.col("size").eqNullSafe(F.col("had"))
    return listing.join(before, "path", "left").where(~same & (F.col("modified") + quiet <= now)).select("path", "modified", "size")


def follow(spark, folder: str, analyse: Callable[[DataFrame], DataFrame], scan: Callable[[], DataFrame], listing: Callable[[], DataFrame], quiet: float = 0.3, every: float = 1.0, initial: bool = True, rounds: int | None = None) -> Iterator[tuple[str, DataFrame]]:
    """Look at a folder again and again: ``("initial", issues)`` of all files, then ``("changed", issues)`` of those that changed.

    The files' times and sizes are kept as a table in the folder ``spark.checkpoint.dir`` between rounds, and are what they
    were when the round began, so a change during an analysis is seen by the next round.  ``rounds`` ends it; None doesn't.
    """
    state = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"

    def keep(table: DataFrame, number: int) -> DataFrame:
        table.write.parquet(f"{state}/{number}")
        return spark.read.parquet(f"{state}/{number}")

    known = keep(listing(), 0)
    if initial:
        yield "initial", analyse(scan())
    number = 0
    while rounds is None or number < rounds:
        number += 1
        time.sleep(every)
        seen = keep(ready(listing(), known, time.time(), quiet), 2 * number)
        if seen.isEmpty():
            continue
        yield "changed", analyse(scan().join(seen.select("path"), "path", "left_semi"))
        known = keep(known.join(seen.select("path"), "path", "left_anti").unionByName(seen), 2 * number + 1)
