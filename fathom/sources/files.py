"""Source files as rows, and what a run can see of them without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = ("target/", "build/", "node_modules/", ".git/")


#: The reader's own limit on a file's bytes.
LONGEST = "spark.sql.sources.binaryFile.maxLength"


def _binary(spark: SparkSession, path: str, glob: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder, without those whose path holds an excluded text.

    The paths are those of the listing, so a file that is left out isn't opened.  There they are spelled as addresses.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    listed = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    for text in exclude:
        found = found.where(~F.regexp_replace(listed, "^file:/+", "/").contains(text))
    return found


def _plain(path: str = "path") -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _read(found: DataFrame) -> DataFrame:
    """``(path, src)`` of a listing: what isn't UTF-8, and what is longer than the reader takes, has no ``src``.

    Lengths are known from the listing, so a file that is too long isn't opened.
    """
    longest = int(found.sparkSession.conf.get(LONGEST))
    short = found.where(F.col("_metadata.file_size") <= longest).where(F.col("length") <= longest)
    long = found.where(F.col("_metadata.file_size") > longest)
    text = short.select(_plain().alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("src"))
    return text.unionByName(long.select(_plain().alias("path"), F.lit(None).cast("string").alias("src")))


def scan(spark: SparkSession, path: str, exclude: tuple[str, ...] = EXCLUDED, glob: str = "*.java") -> DataFrame:
    """``files(path, src)`` below a folder; paths that hold an excluded text go, and ``src`` is null for what can't be read.

    Paths and lengths are tested before contents are read.
    """
    return _read(_binary(spark, path, glob, exclude))


def scan_all(spark: SparkSession, path: str) -> DataFrame:
    """The same without exclusions, as the search for copies reads it."""
    return scan(spark, path, exclude=())


def scan_one(spark: SparkSession, path: str) -> DataFrame:
    """One file, whatever its name."""
    return _read(spark.read.format("binaryFile").load(path))


def listing(spark: SparkSession, path: str, exclude: tuple[str, ...] = (), glob: str = "*.java") -> DataFrame:
    """``(path, modified, size)``, without contents: times are whole seconds."""
    return _binary(spark, path, glob, exclude).select(_plain().alias("path"), F.unix_seconds("modificationTime").alias("modified"), F.col("length").alias("size"))


def files_analysed(files: DataFrame) -> int:
    """All files of a scan, those that couldn't be read included."""
    return files.select("path").count()
