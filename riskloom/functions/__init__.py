"""Column functions that several operators share; all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding in decimal arithmetic, as double: binary noise can't tip a tie."""
    return F.round(x.cast("decimal(38,12)"), digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def bucket(ts: Column, width: str) -> Column:
    """Start of the tumbling window of ``width`` (such as ``10 minutes``), as timestamp without zone."""
    return F.window(ts.cast("timestamp_ntz"), width)["start"]


def start_of(unit: str, ts: Column) -> Column:
    """``date_trunc`` that keeps timestamps without zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def age_cohort(days: Column, names: tuple[str, ...], limits: tuple[int, ...] = (7, 30, 90)) -> Column:
    """The first name whose limit exceeds ``days``; the last name for all above, and for null."""
    out = F.lit(names[-1])
    for name, limit in reversed(list(zip(names, limits, strict=False))):
        out = F.when(days < limit, name).otherwise(out)
    return out


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    return F.width_bucket(x, F.lit(low), F.lit(high), F.lit(n).cast("long"))
