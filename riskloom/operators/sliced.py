"""Windows over time for keys of any size: slices of (key, time) with halos and carries.

A window by key sorts all rows of a key in one task, so one user with half of the events sets the time of the job.  Here a
key's rows are cut into slices of time, each the work of one task at most.  What a slice needs of the time before it comes
with it: rows of the trailing window as a halo, the last row before it as a carry, sessions by stitching the first and the
last of each slice.  Results equal those of the windows; a row is copied for the slices that its window reaches into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices are so many times as long as the widest window: an eighth of the rows is copied at most, on average.
SLICES_PER_WINDOW = 8
_NEVER = -(1 << 62)


def cut(df: DataFrame, t: Column, length: int, halo: int = 0) -> DataFrame:
    """``df`` with ``_t`` (microseconds), ``_slice`` and ``_halo``: rows, and their copies in slices that begin within ``halo`` after them."""
    timed = df.withColumn("_t", t)
    number = lambda x: F.floor(x / F.lit(length)).cast("long")
    own = F.coalesce(number(F.col("_t")), F.lit(_NEVER))
    if not halo:
        return timed.withColumn("_slice", own).withColumn("_halo", F.lit(False))
    reach = F.coalesce(number(F.col("_t") + halo), F.lit(_NEVER))
    return timed.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(F.col("_own"), reach))).withColumn("_halo", F.col("_slice") != F.col("_own")).drop("_own")


def trailing(sliced: DataFrame, key: str, **counts: tuple[Column, int]) -> DataFrame:
    """``sliced`` with counts of what isn't null over [t - width, t] of the key, by name: (what, width in microseconds), halos gone."""
    w = Window.partitionBy(key, "_slice").orderBy("_t")
    return sliced.select("*", *(F.count(what).over(w.rangeBetween(-width, 0)).alias(name) for name, (what, width) in counts.items())).where(~F.col("_halo"))


def before(sliced: DataFrame, key: str, by: list[str], **values: str) -> DataFrame:
    """``sliced`` (without halo) with the values of the row before in the order of ``by``, by name: column; null for a key's first row."""
    here = Window.partitionBy(key, "_slice").orderBy(*by)
    order, told = F.struct(*by), F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    lagged = sliced.select("*", F.lag(told).over(here).alias("_before"), F.row_number().over(here).alias("_n"))
    last = sliced.where(F.col(key).isNotNull()).groupBy(key, "_slice").agg(F.max_by(told, order).alias("_last"))
    carry = last.select(key, "_slice", F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")).alias("_carry"))  # a row a slice
    out = lagged.join(carry, [key, "_slice"], "left").withColumn("_before", F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_before")))
    return out.select("*", *(F.col("_before")[n].alias(n) for n in values)).drop("_before", "_carry", "_n")


def sessions(sliced: DataFrame, key: str, gap: int, what: Column) -> DataFrame:
    """key, _start, _end (microseconds), _n: sessions of a key, whose rows are at most ``gap`` apart; _n counts what isn't null.

    Rows without time belong to no session.  ``sliced`` has no halo.
    """
    slice_ = Window.partitionBy(key, "_slice").orderBy("_t")
    rows = sliced.where("_t is not null").select(key, "_slice", "_t", what.alias("_what"))
    new = F.coalesce((F.col("_t") - F.lag("_t").over(slice_) > gap).cast("int"), F.lit(0))
    numbered = rows.withColumn("_new", new).withColumn("_no", F.sum("_new").over(slice_.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(key, "_slice", "_no").agg(F.min("_t").alias("_start"), F.max("_t").alias("_end"), F.count("_what").alias("_n"))
    ends = pieces.withColumn("_edge", (F.col("_no") == 0) | (F.col("_no") == F.max("_no").over(Window.partitionBy(key, "_slice"))))
    # two rows a slice at most
    line = Window.partitionBy(key).orderBy("_start")
    joined = ends.where("_edge").withColumn("_new", F.coalesce((F.col("_start") - F.lag("_end").over(line) > gap).cast("int"), F.lit(0)))
    stitched = joined.withColumn("_no", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = stitched.groupBy(key, "_no").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("_n").alias("_n"))
    return whole.select(key, "_start", "_end", "_n").unionByName(ends.where(~F.col("_edge")).select(key, "_start", "_end", "_n"))
