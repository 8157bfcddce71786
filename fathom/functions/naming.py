"""Case conversions of identifiers, and texts of durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_camel_case(name: str) -> str:
    """Snake parts joined with capitals; without underscores only the first letter changes."""
    head, *rest = [p for p in name.split("_") if p] or [""]
    if rest:
        return head.lower() + "".join(p[:1].upper() + p[1:].lower() for p in rest)
    return head[:1].lower() + head[1:]


def to_pascal_case(name: str) -> str:
    parts = [p for p in name.split("_") if p]
    if len(parts) > 1:
        return "".join(p[:1].upper() + p[1:].lower() for p in parts)
    return "".join(p[:1].upper() + p[1:] for p in parts)


def to_upper_snake_case(name: str) -> str:
    """An underscore before a capital that follows a small letter or a digit; runs of capitals stay together."""
    out, small = [], False
    for c in name:
        if c.isupper() and small:
            out.append("_")
        out.append(c.upper())
        small = c.islower() or c.isdigit()
    return "".join(out)


def format_debt(minutes: Column) -> Column:
    """Days of eight hours, hours and minutes: ``1d 2h 5min``; ``0min`` for nothing."""
    days, hours, rest = (minutes / 480).cast("long"), (minutes % 480 / 60).cast("long"), (minutes % 60).cast("long")
    parts = F.array_compact(F.array(F.when(days > 0, F.concat(days.cast("string"), F.lit("d"))), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))), F.when((rest > 0) | (minutes == 0), F.concat(rest.cast("string"), F.lit("min")))))
    return F.array_join(parts, " ")
