"""Issues against an earlier run's, by rule, file, line and the hash of the lines around, if there is one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What tells one issue from another; nulls are equal to each other and to nothing else.
KEY = ("rule_id", "file", "line", "context_hash")
HASH = "decimal(20,0)"


def hashed(rows: DataFrame) -> DataFrame:
    """Issues or fingerprints with a ``context_hash``: their own, or null."""
    own = F.col("context_hash").cast(HASH) if "context_hash" in rows.columns else F.lit(None).cast(HASH)
    return rows.withColumn("context_hash", own)


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    a, b = hashed(left), hashed(right).select(*KEY)
    return a.join(b, [a[k].eqNullSafe(b[k]) for k in KEY], how).select(*left.columns)


def unchanged(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues that the baseline has."""
    return _joined(issues, baseline, "left_semi")


def new(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    return _joined(issues, baseline, "left_anti")


def fixed(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows of the baseline that no issue has any more, repeats included."""
    return _joined(baseline, issues, "left_anti")


def tally(rows: DataFrame) -> DataFrame:
    """How often each key of ``rows(*KEY, now, then)`` is among the issues and in the baseline: one shuffle of small rows."""
    return rows.groupBy(*KEY).agg(F.sum("now").alias("now"), F.sum("then").alias("then"))


def both(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues and a baseline as rows for :func:`tally`."""
    side = lambda df, now: hashed(df).select(*KEY, F.lit(now).alias("now"), F.lit(1 - now).alias("then"))
    return side(issues, 1).unionByName(side(baseline, 0))


def told(keys: DataFrame, kind: str) -> DataFrame:
    """The fingerprints of a tally that are ``new``, ``fixed`` or ``unchanged``, each as often as it was there."""
    times = {"new": F.when(F.col("then") == 0, F.col("now")), "fixed": F.when(F.col("now") == 0, F.col("then")), "unchanged": F.when((F.col("now") > 0) & (F.col("then") > 0), F.col("now"))}[kind]
    return keys.select(*KEY, F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("each")).drop("each")


def counted(keys: DataFrame) -> DataFrame:
    """One row: counts of new, fixed and unchanged issues, and new less fixed, of a tally."""
    cases = (("new", F.when(F.col("then") == 0, F.col("now"))), ("fixed", F.when(F.col("now") == 0, F.col("then"))), ("unchanged", F.when((F.col("now") > 0) & (F.col("then") > 0), F.col("now"))))
    counts = keys.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for a, c in cases])
    return counts.withColumn("net_change", F.col("new") - F.col("fixed"))


def comparison(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """:func:`counted` of issues against a baseline."""
    return counted(tally(both(issues, baseline)))


def baseline_of(issues: DataFrame) -> DataFrame:
    """The rows that a baseline keeps: fingerprints, with the hash of the lines around where the issues have one."""
    return hashed(issues).select(*KEY)


#: Version of a baseline's format, and the file beside its rows that tells about it.
FORMAT, ABOUT = "1.0", "_baseline.json"


def save(issues: DataFrame, path: str, description: str | None = None) -> None:
    """As a directory of JSON lines, written in parallel; each line is a fingerprint.

    Version, time and description stand in a file beside them that readers of tables pass over.
    """
    baseline_of(issues).write.json(path)
    spark = issues.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{ABOUT}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(_about(description)), "utf-8"))
    out.close()


def _about(description: str | None) -> dict:
    return {"version": FORMAT, "created_at": datetime.now(timezone.utc).isoformat(), "description": description}


def about(spark, path: str) -> dict | None:
    """Version, time and description of a saved baseline, in either form."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{ABOUT}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        stream = system.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
    df = spark.read.json(path, multiLine=True)
    told = [c for c in ("version", "created_at", "description") if c in df.columns]
    return df.select(*told).first().asDict() if told else None


def document(issues: DataFrame, description: str | None = None) -> Iterator[str]:
    """A baseline as one JSON document, in pieces; rows come to the driver a partition at a time."""
    head = json.dumps(_about(description), indent=2)
    yield head.rstrip("}\n") + ',\n  "fingerprints": ['
    rows = baseline_of(issues).select(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}).alias("value"))
    for n, r in enumerate(rows.toLocalIterator()):
        yield ("," if n else "") + "\n    " + r.value
    yield "\n  ]\n}\n"


def load(spark, path: str) -> DataFrame:
    """Fingerprints of a directory of JSON lines, or of a single document with a list of them.

    They have a ``context_hash`` if the file has any.
    """
    df = spark.read.json(path)
    if "fingerprints" in df.columns or "_corrupt_record" in df.columns:
        df = spark.read.json(path, multiLine=True).select(F.explode("fingerprints").alias("f")).select("f.*")
    own = [F.col("context_hash").cast(HASH)] if "context_hash" in df.columns else []
    return df.select("rule_id", "file", F.col("line").cast("int"), *own)
