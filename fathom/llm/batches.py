"""Arrow batches to plain Python columns and back, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes of Arrow data, that are turned into Python objects at once; a row that is larger is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def vocabulary_file(name: str) -> str:
    """The path of a public tokenizer's vocabulary by its name, on the machine that asks; a path stays as it is."""
    return name if "/" in name else str(public_tokenizers.path(name))


def quoted(name: str) -> str:
    """A column's name as SQL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def ddl_of(df: DataFrame) -> str:
    """The columns of a table as a schema string."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema)


def cut(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, each of so many rows and bytes at most or of one row."""
    rest = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
    while rest:
        part = rest.pop()
        if part.num_rows > 1 and part.nbytes > size:
            half = part.num_rows // 2
            rest += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """Each slice as one list per column, in column order."""
    for batch in batches:
        for part in cut(batch, rows):
            yield [column.to_pylist() for column in part.columns]


def map_batches(df: DataFrame, columns: list[str], ddl: str, task: Callable[[Iterator[list[list]]], Iterator[list]], rows: int = SLICE_ROWS) -> DataFrame:
    """Run ``task`` in each partition over slices of the named columns; it yields lists of output columns.

    Only ``columns`` are read, by name, so other columns of the input can have any name.
    """
    schema = schema_of(ddl)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for out in task(slices(batches, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(values, type=field.type) for values, field in zip(out, arrow)], schema=arrow)

    picked = [F.col(c).alias(f"c{n}") for n, c in enumerate(columns)]
    return df.select(*picked).mapInArrow(run, schema)
