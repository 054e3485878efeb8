"""Event logs: reading with partition pruning, adapting, validating and normalising them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("user_id", "ip_address", "device_id", "session_id", "action", "timestamp")


def write_events(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Writes a log partitioned by month; rows are sorted by user and time within files, for min/max skipping."""
    month = F.date_format(F.col(ts), "yyyy-MM")
    df.withColumn("event_month", month).repartition("event_month", F.pmod(F.xxhash64("user_id"), F.lit(64))).sortWithinPartitions("user_id", ts).write.mode("overwrite").partitionBy("event_month").parquet(path)


def read_events(spark: SparkSession, path: str, start: dt.datetime, end: dt.datetime, ts: str = "ts") -> DataFrame:
    """The rows with ``start <= ts <= end``; the derived month column prunes partitions, ts prunes row groups."""
    months = F.col("event_month").between(start.strftime("%Y-%m"), end.strftime("%Y-%m"))
    return spark.read.option("recursiveFileLookup", "false").parquet(path).where(months & between(F.col(ts), start, end)).drop("event_month")


def between(ts: Column, start: dt.datetime, end: dt.datetime) -> Column:
    """Both ends included; compared without zone, so that the predicate reaches the scan."""
    literal = lambda x: F.lit(x.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return ts.between(literal(start), literal(end))


def feature_view(raw_events: DataFrame) -> DataFrame:
    """Raw events in the names of the feature builder."""
    return raw_events.select(
        "event_id", "user_id", F.col("ts").alias("timestamp"), "session_id", "ip_address", "device_id",
        F.col("action_type").alias("action"), F.col("enforcement_action").isNotNull().cast("int").alias("enforced"),
    )


def validate(df: DataFrame, required: tuple[str, ...] = REQUIRED, check_empty: bool = False) -> DataFrame:
    """ValueError for missing columns, and, if asked (it costs a job), for an empty frame."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if check_empty and df.isEmpty():
        raise ValueError("no events")
    return df


def normalise(df: DataFrame, tie_break: str | None = None) -> DataFrame:
    """Typed, free of duplicates of (user_id, timestamp, action).

    Of duplicates the row with the smallest ``tie_break`` stays; without such a
    column all other columns order them, so that reruns agree.
    """
    validate(df)
    out = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if "enforced" in df.columns:
        number = F.when(F.lower(F.col("enforced").cast("string")) == "true", 1.0).otherwise(F.col("enforced").cast("string").try_cast("double"))
        out = out.withColumn("enforced", F.coalesce(number, F.lit(0.0)).cast("int"))
    tie_break = tie_break or ("event_id" if "event_id" in df.columns else None)
    order = [tie_break] if tie_break else [c for c in out.columns if c not in ("user_id", "timestamp", "action")]
    first = Window.partitionBy("user_id", "timestamp", "action").orderBy(*order)
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def weekly_spine(spark: SparkSession, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """``week_start`` for every week from that of ``start`` to that of ``end``."""
    a, b = (F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") for x in (start, end))
    week = lambda x: F.date_trunc("week", x).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(F.sequence(week(a), week(b), F.expr("interval 7 days"))).alias("week_start"))


def weekly_counts(events: DataFrame, column: str) -> DataFrame:
    """``week_start`` and ``events`` for every week from that of the first to that of the last time in ``column``, empty weeks too."""
    week = F.date_trunc("week", F.col(column)).cast("timestamp_ntz")
    counted = events.where(F.col(column).isNotNull()).groupBy(week.alias("week_start")).agg(F.count("*").alias("events"))
    ends = counted.agg(F.min("week_start").alias("a"), F.max("week_start").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week_start"))
    return spine.join(counted, "week_start", "left").select("week_start", F.coalesce("events", F.lit(0)).alias("events"))
