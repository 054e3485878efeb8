"""Unordered pairs of users that share signals, without n * (n - 1) / 2 rows for each signal.

Signals of few users (light) are joined with themselves.  The others (heavy) are few, so each user's heavy signals are one
small set, and users with equal sets are one class.  What two users share of heavy signals is found once for their two
classes; a pair of classes stands for all pairs of their users and is expanded into rows only if its users have enough in
common.  So a signal of very many users costs what the edges that come out cost, however many signals they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Users of a class that one row holds when classes are expanded.
BLOCK = 256


def _count(of: Column, kind: str) -> Column:
    return F.size(F.filter(of, lambda x: x["kind"] == kind)).cast("long")


def _light(seen: DataFrame) -> DataFrame:
    """src < dst and the signals of each kind that they share, by a self-join."""
    both = seen.withColumnRenamed("user_id", "src").join(seen.withColumnRenamed("user_id", "dst"), ["kind", "value"]).where("src < dst")
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(kind)
    return both.groupBy("src", "dst").agg(count("ip"), count("device"))


def _class_pairs(classes: DataFrame, least: int) -> DataFrame:
    """a, b, ip, device: classes (a <= b) with at least ``least`` heavy signals in common, a class with itself too."""
    sets = classes.select("class", "held", F.size("held").alias("_n")).where(F.col("_n") >= least)
    if least == 1:
        keys = F.transform("held", lambda x: F.struct(x.alias("x"), F.lit(None).cast("struct<kind:string,value:string>").alias("y")))
    else:  # two that share at least two signals share a pair of them
        keys = F.flatten(F.transform("held", lambda x: F.transform(F.filter("held", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    keyed = durable(sets.select("class", "held", F.explode(keys).alias("key")).withColumn("key", F.sha2(F.to_json("key"), 256)))  # written, so that the join can split a key
    met = keyed.select(F.col("class").alias("a"), F.col("held").alias("ha"), "key").join(keyed.select(F.col("class").alias("b"), F.col("held").alias("hb"), "key"), "key").where("a <= b")
    shared = F.array_intersect("ha", "hb")
    return met.select("a", "b", _count(shared, "ip").alias("ip"), _count(shared, "device").alias("device")).where(F.col("ip") + F.col("device") >= least).distinct()


def _expanded(users: DataFrame, pairs: DataFrame) -> DataFrame:
    """src < dst, ip, device: a row for each two users of two classes; users stand in blocks, so that a large class is many tasks."""
    block = F.pmod(F.xxhash64("user_id"), F.ceil(F.col("_size") / BLOCK))
    sized = users.join(users.groupBy("class").agg(F.count("*").alias("_size")), "class")
    blocks = durable(sized.withColumn("block", block).groupBy("class", "block").agg(F.collect_list("user_id").alias("members")))
    side = lambda c: blocks.select(F.col("class").alias(c), F.col("block").alias(f"_{c}"), F.col("members").alias(f"m{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a") < F.col("b")) | (F.col("_a") <= F.col("_b")))
    rows = met.select("a", "b", "_a", "_b", "ip", "device", F.explode("ma").alias("u"), "mb").select("a", "b", "_a", "_b", "ip", "device", "u", F.explode("mb").alias("v"))
    once = rows.where((F.col("a") < F.col("b")) | (F.col("_a") < F.col("_b")) | (F.col("u") < F.col("v")))
    return once.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "ip", "device")


def shared(seen: DataFrame, least: int = 1, heavy: int = 1000) -> DataFrame:
    """src < dst, ip, device (numbers of signals in common), for users with at least ``least`` in common.

    ``seen``: distinct kind (ip or device), value, user_id.  Signals of more than ``heavy`` users are heavy; the result
    doesn't depend on it.
    """
    seen = durable(seen)
    many = durable(seen.groupBy("kind", "value").agg(F.count("*").alias("_users")).where(F.col("_users") > heavy).select("kind", "value"))
    if many.isEmpty():
        return _light(seen).where(F.col("ip") + F.col("device") >= least)
    light = _light(seen.join(many, ["kind", "value"], "left_anti"))
    sets = seen.join(many, ["kind", "value"]).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value"))).alias("held"))
    users = durable(sets.withColumn("class", F.sha2(F.to_json("held"), 256)))
    by_class = users.groupBy("class").agg(F.first("held").alias("held"))
    found = _expanded(users.select("user_id", "class"), durable(_class_pairs(by_class, least)))
    if least == 1:
        # every pair with a heavy signal in common is found; light signals are added
        return light.unionByName(found).groupBy("src", "dst").agg(F.sum("ip").alias("ip"), F.sum("device").alias("device"))
    # pairs with a light signal in common get their heavy ones added; of pairs found on both sides the larger counts are whole
    held = users.select("user_id", "held")
    a, b = (held.select(F.col("user_id").alias(c), F.col("held").alias(f"h{c}")) for c in ("src", "dst"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    common = F.array_intersect(F.coalesce("hsrc", none), F.coalesce("hdst", none))
    whole = light.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", (F.col("ip") + _count(common, "ip")).alias("ip"), (F.col("device") + _count(common, "device")).alias("device"))
    return whole.unionByName(found).groupBy("src", "dst").agg(F.max("ip").alias("ip"), F.max("device").alias("device")).where(F.col("ip") + F.col("device") >= least)
