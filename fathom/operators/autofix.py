"""Edits of fixes, applied to sources."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import split_lines


def apply_edits(src: str, edits: Iterable) -> str:
    """Edits by lines and byte columns, the last place first; lines are joined by feeds, without one at the end."""
    lines = [line.encode() for line in split_lines(src)]
    for e in sorted(edits, key=lambda e: (e["start_line"], e["start_column"]), reverse=True):
        a, b = e["start_line"] - 1, e["end_line"] - 1
        if not 0 <= a <= b < len(lines):
            continue
        whole = lines[a][: e["start_column"] - 1] + e["replacement"].encode() + lines[b][e["end_column"] - 1 :]
        lines[a : b + 1] = whole.split(b"\n")
    return "\n".join(line.decode("utf-8", "replace") for line in lines)


def fixed_files(files: DataFrame, issues: DataFrame) -> DataFrame:
    """``files(path, src)`` that have fixes, with these applied; a file's edits are gathered with its row."""
    edits = issues.where("fix is not null").select(F.col("file").alias("path"), F.explode("fix.edits").alias("edit")).groupBy("path").agg(F.collect_set("edit").alias("edits"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "src": [apply_edits(s, e) for s, e in zip(frame["src"], frame["edits"])]})

    return files.join(edits, "path").select("path", "src", "edits").mapInPandas(run, "path string, src string")
