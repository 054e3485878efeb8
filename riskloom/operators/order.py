"""Global order without a global window: ranges of keys, places within them, offsets from the totals of the ranges.

A window without a partition sorts all rows in one task.  Here the rows are dealt to ranges, which are sorted by as many
tasks; what meets in one place is one total for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

_ROW_BITS = 33  # monotonically_increasing_id: the partition, then 33 bits of the row in it


def ranged(df: DataFrame, *by: Column | str, parts: int | None = None) -> DataFrame:
    """``df``, written, with ``_part`` (ascending in the order of ``by``) and ``_row`` (0-based, in order, within the part).

    Rows with equal ``by`` are told apart by where they were read, so a very common key is cut over several ranges.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    told = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(n, *by, "_tie").sortWithinPartitions(*by, "_tie").withColumn("_id", F.monotonically_increasing_id())
    placed = dealt.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn("_row", F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1))
    return durable(placed.drop("_tie", "_id"))


def offsets(cut: DataFrame, *sums: Column) -> DataFrame:
    """``_part``, ``_before`` (rows in earlier parts) and ``_s0``, ``_s1``... (``sums`` over earlier parts): a row for each range."""
    totals = cut.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(s).alias(f"_t{i}") for i, s in enumerate(sums)))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the rows
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return totals.select("_part", before("_n").alias("_before"), *(before(f"_t{i}").alias(f"_s{i}") for i in range(len(sums))))


def positions(df: DataFrame, *by: Column | str, parts: int | None = None) -> DataFrame:
    """``df``, written, with ``_at``: the 0-based place of the row in the order of ``by``; rows with equal keys in any order."""
    cut = ranged(df, *by, parts=parts)
    # a row for each range on the broadcast side
    return cut.join(F.broadcast(offsets(cut)), "_part").withColumn("_at", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def ranks(df: DataFrame, keys: dict[str, bool], parts: int | None = None) -> DataFrame:
    """The distinct ``keys`` (name: descending?) with ``rank`` and ``dense_rank``, both long, as SQL numbers the rows of ``df``.

    Keys are counted first, so ties never meet as rows.  Nulls rank last where descending, else first.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_ties"))
    order = [F.desc_nulls_last(k) if down else F.asc_nulls_first(k) for k, down in keys.items()]
    cut = ranged(counted, *order, parts=parts)
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(offsets(cut, F.col("_ties"))), "_part").select(
        *keys,
        (F.col("_s0") + F.coalesce(F.sum("_ties").over(within), F.lit(0)) + 1).alias("rank"),
        (F.col("_before") + F.col("_row") + 1).alias("dense_rank"),
    )
