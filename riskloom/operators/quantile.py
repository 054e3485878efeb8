"""Exact quantiles by distributed selection.

``percentile`` keeps every distinct value in one buffer.  Here two pivots that a sketch of bounded size puts close around
the rank cut the values into below, between and above, which one pass counts; only the range that holds the rank is looked
at again, until it is small enough to be sorted.  The sketch decides how few passes it takes, never the result: pivots are
values of the range, and counts are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

ACCURACY = 10_000


def _within(value: Column, low: float | None, high: float | None) -> Column:
    """Strictly between; None is no bound."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value > F.lit(low))
    return inside if high is None else inside & (value < F.lit(high))


def _kth(df: DataFrame, v: Column, k: int, total: int, small: int) -> float:
    """The value with ``k`` values before it in ascending order."""
    low = high = None
    before, size = 0, total
    while size > small:
        held = df.where(_within(v, low, high))
        place, slack = (k - before) / size, 2.0 / ACCURACY
        marks = [max(0.0, place - slack), min(1.0, place + slack)]
        first, last = held.agg(F.percentile_approx(v, marks, ACCURACY).alias("p")).first().p
        is_count = lambda c: F.count(F.when(c, 1))
        below, at_first, between, at_last = held.agg(is_count(v < first), is_count(v == first), is_count((v > first) & (v < last)), is_count((v == last) & (v > first))).first()
        k_here = k - before
        if k_here < below:
            high, size = first, below
        elif k_here < below + at_first:
            return first
        elif k_here < below + at_first + between:
            low, high, before, size = first, last, before + below + at_first, between
        elif k_here < below + at_first + between + at_last:
            return last
        else:
            gone = below + at_first + between + at_last
            low, before, size = last, before + gone, size - gone
    held = df.where(_within(v, low, high))
    return held.agg(F.sort_array(F.collect_list(v)).alias("all")).select(F.get("all", F.lit(k - before))).first()[0]  # at most ``small`` values


def quantile(df: DataFrame, column: str, q: float, small: int = 10_000) -> float | None:
    """The quantile ``q`` of the non-null values, interpolated as ``percentile`` does; None where there are none.

    ``df`` is read a few times, so what takes long to make is best written before.  NaN counts as the largest value, as in any
    order of Spark.  No task holds more than ``small`` values or one sketch.
    """
    if not 0 <= q <= 1:
        raise ValueError("q is a share")
    v = F.col(column).cast("double")
    total = df.agg(F.count(v)).first()[0]
    if not total:
        return None
    place = (total - 1) * q
    lower = math.floor(place)
    a = _kth(df, v, lower, total, small)
    if place == lower:
        return a
    upto, following = df.agg(F.count(F.when(v <= a, 1)), F.min(F.when(v > a, v))).first()
    b = a if upto > lower + 1 else following
    return a if a == b else (lower + 1 - place) * a + (place - lower) * b


def written(df: DataFrame, column: str) -> DataFrame:
    """Only ``column``, written, for ``quantile`` over what takes long to make."""
    return durable(df.select(column))
