"""Changes of a folder's files as a stream, and the pause that ends a burst of them by the clock."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.functions.folders import shared_folder
from fathom.sources.files import EXCLUDED

#: Changes in one piece of the log, which one task reads.
PIECE_ROWS = 10_000


class Piece(InputPartition):
    """A piece of an entry of the log."""

    def __init__(self, entry: int, piece: int):
        self.entry, self.piece = entry, piece


class FolderReader(DataSourceStreamReader):
    """Looks at a folder when the stream asks for news, and keeps what it saw in a log.

    An entry of the log holds the changes between two looks, and a snapshot the files' times and sizes at the second one; both
    are written before the entry's number is told as an offset.  So a stream that starts again, with the same folder of state,
    reads what it hadn't committed from the log, goes on from the snapshot, and sees what changed while it was down.
    """

    def __init__(self, options: dict):
        self.folder, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.ending, self.exclude = options.get("ending", ".java"), json.loads(options.get("exclude", json.dumps(EXCLUDED)))
        self.initial = options.get("initial", "true").lower() == "true"
        self.entry: int | None = None

    # The log

    def _place(self, name: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.state)
        return system, posixpath.join(root, name)

    def _write(self, name: str, value) -> None:
        """A whole file, or none: it gets its name when it is complete."""
        system, path = self._place(name)
        system.create_dir(posixpath.dirname(path), recursive=True)
        with system.open_output_stream(f"{path}.part") as out:
            out.write(json.dumps(value).encode())
        system.move(f"{path}.part", path)

    def _read(self, name: str):
        system, path = self._place(name)
        with system.open_input_stream(path) as data:
            return json.loads(data.read())

    def _names(self, kind: str) -> list[int]:
        """Numbers of the entries, or of the snapshots, that there are."""
        system, root = self._place(kind)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(i.base_name) for i in found if i.base_name.isdigit())

    # The folder

    def _listing(self) -> dict[str, list]:
        system, root = fs.FileSystem.from_uri(self.folder)
        files = (i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(self.ending))
        return {i.path: [i.mtime_ns, i.size] for i in files if not any(text in i.path for text in self.exclude)}

    def _resume(self) -> None:
        if self.entry is not None:
            return
        numbers = self._names("snapshot")
        if numbers:
            self.entry, self.known = numbers[-1], self._read(f"snapshot/{numbers[-1]}")
        else:
            self.entry, self.known = 0, {} if self.initial else self._listing()
            self._write("snapshot/0", self.known)

    # What the stream asks for

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        self._resume()
        now = self._listing()
        changed = sorted(p for p, facts in now.items() if self.known.get(p) != facts)
        if changed:
            number, told = self.entry + 1, datetime.now(timezone.utc).timestamp()
            pieces = [changed[at : at + PIECE_ROWS] for at in range(0, len(changed), PIECE_ROWS)]
            for n, paths in enumerate(pieces):
                self._write(f"piece/{number}-{n}", [[p, told] for p in paths])
            self._write(f"entry/{number}", len(pieces))
            self._write(f"snapshot/{number}", now)
            self.entry = number
        self.known = now
        return {"entry": self.entry}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(k, n) for k in range(start["entry"] + 1, end["entry"] + 1) for n in range(self._read(f"entry/{k}"))]

    def read(self, partition: Piece) -> Iterator[tuple]:
        for path, told in self._read(f"piece/{partition.entry}-{partition.piece}"):
            yield path, datetime.fromtimestamp(told, timezone.utc)

    def commit(self, end: dict) -> None:
        """Entries that the stream is done with go, and snapshots before the last one."""
        system, _ = self._place("")
        last = max(self._names("snapshot"), default=0)
        old = [f"snapshot/{k}" for k in self._names("snapshot") if k < min(end["entry"], last)]
        for k in self._names("entry"):
            if k <= end["entry"]:
                old += [*(f"piece/{k}-{n}" for n in range(self._read(f"entry/{k}"))), f"entry/{k}"]
        for name in old:
            path = self._place(name)[1]
            if system.get_file_info(path).type == fs.FileType.File:
                system.delete_file(path)


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes")``: ``(path, ts)`` of each file that is new or has changed.

    Options: ``path`` of the folder and ``state``, where the log is kept (both as paths or addresses that pyarrow knows),
    ``ending`` of the files' names, ``exclude``, a JSON list of texts that their paths may not hold, and ``initial``, whether
    the files that are there at the first start count as changes.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, ts timestamp"

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def changes(spark: SparkSession, folder: str, state: str, **options: str) -> DataFrame:
    """The stream of a folder's changes; ``state`` has to be the same when it starts again."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=folder, state=state, **options).load()


def paused(stream: DataFrame, quiet: float = 0.3) -> DataFrame:
    """``(path, first, last, n)`` of each burst of ``stream(path, ts)``, told once the path has been quiet for so many seconds.

    Each path has its state and a timer of the clock, so a pause is told by the next trigger behind it and no later change has
    to come first.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            at = lambda micros: pd.Timestamp(micros, unit="us")
            yield pd.DataFrame({"path": [key[0]], "first": [at(first)], "last": [at(last)], "n": [n]})
            return
        first, last, n = state.get if state.exists else (2**63 - 1, -(2**63), 0)
        for frame in frames:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            first, last, n = min(first, int(micros.min())), max(last, int(micros.max())), n + len(frame)
        state.update((first, last, n))
        state.setTimeoutDuration(max(1, int(quiet * 1000)))

    return stream.groupBy("path").applyInPandasWithState(step, "path string, first timestamp, last timestamp, n long", "first long, last long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(spark: SparkSession, folder: str, read: Callable[[DataFrame], DataFrame], analyse: Callable[[DataFrame], DataFrame], out: str, state: str | None = None, quiet: float = 0.3, every: str = "1 second", **options: str):
    """A running query over a folder: a file's issues are written each time that it has changed and is quiet again.

    ``read`` turns ``(path)`` into ``files(path, src)``.  The log of changes and the query's checkpoint are in ``state``, by
    default a folder of its own in the shared one; given the same one, the query goes on where it was stopped, and a batch
    that runs again overwrites its own rows of ``out``.
    """
    state = state or f"{shared_folder(spark)}/watch"

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return  # timers ask for a batch at every trigger
        analyse(read(batch.select("path").distinct())).write.mode("overwrite").parquet(f"{out}/batch={number}")

    bursts = paused(changes(spark, folder, f"{state}/log", **options), quiet)
    return bursts.writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", f"{state}/query").trigger(processingTime=every).start()
