"""Synthetic events, drawn by hashes in parallel: single accounts with infrastructure of their own, and rings that share theirs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ring:
    """Accounts that share ``addresses`` and ``devices`` and are active within ``hours`` of each other."""

    name: str
    accounts: int
    addresses: int
    devices: int
    hours: float


@dataclass(frozen=True)
class Model:
    rings: tuple[Ring, ...] = (Ring("quarry", 12, 3, 2, 6.0), Ring("kiln", 7, 1, 1, 1.5), Ring("orchard", 3, 2, 3, 12.0))
    singles: int = 40
    #: Events of an account: between half and one and a half times as many.
    events: int = 24
    days: int = 14
    start: str = "2024-03-01 00:00:00"
    #: Chance of an enforced event, by ring member or not.
    enforced: tuple[float, float] = (0.15, 0.01)
    actions: tuple[str, ...] = ("browse", "sign_in", "checkout", "message", "upload")
    seed: int = 1


def _draw(m: Model, tag: str, n: Column | int, *by: str) -> Column:
    """A whole number below ``n`` that depends on the seed, what it is for and the columns ``by`` alone."""
    return F.pmod(F.xxhash64(F.lit(m.seed), F.lit(tag), *by), F.lit(n).cast("long") if isinstance(n, int) else n.cast("long"))


def accounts(spark: SparkSession, m: Model | None = None) -> DataFrame:
    """user_id, number (of the account), home (number of its infrastructure), addresses, devices, seconds (its span), in_ring."""
    m = m or Model()
    kinds = "user_id string, number long, home long, addresses long, devices long, seconds long, in_ring boolean"
    alone = spark.range(m.singles).select(
        F.concat(F.lit("single-"), F.col("id")).alias("user_id"), F.col("id").alias("number"), F.col("id").alias("home"),
        (1 + _draw(m, "addresses", 4, "id")).alias("addresses"), (1 + _draw(m, "devices", 2, "id")).alias("devices"),
        F.lit(m.days * 86_400).cast("long").alias("seconds"), F.lit(False).alias("in_ring"),
    )
    members, number = [], m.singles
    for i, ring in enumerate(m.rings):
        members += [(f"{ring.name}-{k}", number + k, m.singles + i, ring.addresses, ring.devices, int(ring.hours * 3600), True) for k in range(ring.accounts)]
        number += ring.accounts
    return alone.unionByName(spark.createDataFrame(members, kinds))


def ring_events(spark: SparkSession, m: Model | None = None) -> DataFrame:
    """event_id, user_id, ip_address, device_id, session_id, action, timestamp, enforced; the same for the same model."""
    m = m or Model()
    events = accounts(spark, m).withColumn("k", F.explode(F.sequence(F.lit(0), m.events // 2 + _draw(m, "events", m.events, "number") - 1)))
    each = ("number", "k")
    # spans of one home begin together, so that the members of a ring overlap in time
    second = _draw(m, "begin", m.days * 86_400 - F.col("seconds") + 1, "home") + _draw(m, "second", F.col("seconds"), *each)
    address = F.col("home") * 16 + _draw(m, "address", F.col("addresses"), *each)
    return events.withColumn("at", second).withColumn("address", address).select(
        (F.col("number") * (2 * m.events) + F.col("k")).alias("event_id"),
        "user_id",
        F.concat_ws(".", F.lit("10"), *(F.shiftright("address", bits).bitwiseAND(255).cast("string") for bits in (16, 8, 0))).alias("ip_address"),
        F.concat_ws("-", F.lit("unit"), F.col("home").cast("string"), _draw(m, "device", F.col("devices"), *each).cast("string")).alias("device_id"),
        F.concat_ws("/", "user_id", F.floor(F.col("at") / 86_400).cast("string")).alias("session_id"),
        F.element_at(F.array(*map(F.lit, m.actions)), (1 + _draw(m, "action", len(m.actions), *each)).cast("int")).alias("action"),
        (F.lit(m.start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("at").cast("decimal(18,6)"))).alias("timestamp"),
        (_draw(m, "enforced", 10_000, *each) < F.when(F.col("in_ring"), 10_000 * m.enforced[0]).otherwise(10_000 * m.enforced[1])).cast("int").alias("enforced"),
    )
