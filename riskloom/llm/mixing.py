"""Mixing sources to target weights (operator 4), DataFrame functions only.

Weighted fair queueing: the documents of a source are shuffled by a hash and
queue up; a document's virtual finish time is the source's cumulative words up
to and including it, divided by the source's target.  A source may be passed
through up to ``repeats`` times, copies following each other in the queue.  All
queues are merged by virtual finish time and cut off at the total budget.

No task ever sees a whole source.  A running sum over a source is made in two
steps: sums of 4096 hash buckets a source, then sums within one bucket.  The
global cut is found in the same way: sums of narrow slots of virtual time tell
in which slot the budget ends, and only that slot's rows are ranked.

Targets share the total of all sizes by weight; one that exceeds ``repeats``
times its source's size stops there, and the excess is shared anew among the
others by weight.  The fixed point is found in closed form: sources sorted by
size per weight are filled up from the smallest.

Cases: null text has size 0; documents of size 0 are never taken; a null source
is a source, the last; equal rows queue one after the other, and rows of one
doc_id (or of none) by size and a hash of the text; an empty table gives an
empty result; other columns pass through (``_rl_`` begins the names of
this module's own).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import durable
from ._text import WORD


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (5, 2, 1)
    repeats: int = 3
    seed: str = "mix:"
    slots: int = 4_096  # of one unit of virtual time
    last_slot: int = 8 * 4_096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, s: Settings | None = None) -> DataFrame:
    """_rl_source, _rl_rank, _rl_source_size, _rl_target for every source of ``sized`` (_rl_source, _rl_size)."""
    s = s or Settings()
    by_name = Window.orderBy(F.col("_rl_source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("_rl_need", "_rl_rank").rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*(F.lit(float(w)) for w in s.weights))
    limit = F.col("_rl_source_size") * float(s.repeats)
    per_source = sized.groupBy("_rl_source").agg(F.sum("_rl_size").alias("_rl_source_size"))
    levels = (
        per_source.withColumn("_rl_rank", F.row_number().over(by_name))
        .withColumn("_rl_weight", F.element_at(weights, (F.col("_rl_rank") - 1) % len(s.weights) + 1))
        .withColumn("_rl_need", limit / F.col("_rl_weight"))
        .withColumn("_rl_total", F.sum("_rl_source_size").over(everything).cast("double"))
        .withColumn("_rl_all", F.sum("_rl_weight").over(everything))
        # the level at which this source is the next one to be filled up, all before it being full
        .withColumn("_rl_level", (F.col("_rl_total") - F.coalesce(F.sum(limit).over(filling), F.lit(0.0))) / (F.col("_rl_all") - F.coalesce(F.sum("_rl_weight").over(filling), F.lit(0.0))))
        .withColumn("_rl_open", F.when(F.col("_rl_need") >= F.col("_rl_level"), F.col("_rl_level")))
        # the first source that the level does not fill sets the level of all the open ones
        .withColumn("_rl_final", F.min_by("_rl_open", F.when(F.col("_rl_open").isNotNull(), F.struct("_rl_need", "_rl_rank"))).over(everything))
    )
    return levels.select("_rl_source", "_rl_rank", "_rl_source_size", F.least(limit, F.coalesce(F.col("_rl_final") * F.col("_rl_weight"), limit)).alias("_rl_target"))


def sized(docs: DataFrame, s: Settings) -> DataFrame:
    """Adds what the queue needs: _rl_source, _rl_size, _rl_h (a hash to shuffle by), _rl_bucket (its first part) and _rl_tie (a hash of the text)."""
    h = F.md5(F.concat(F.lit(s.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (
        docs.withColumn("_rl_source", F.col("source")).withColumn("_rl_size", size_of(F.col("text").cast("string")))
        .withColumn("_rl_h", h).withColumn("_rl_bucket", F.substring("_rl_h", 1, 3)).withColumn("_rl_tie", F.xxhash64(F.col("text").cast("string")))
    )


def queued(rows: DataFrame, buckets: DataFrame, s: Settings) -> DataFrame:
    """Adds _rl_rank, _rl_source_size, _rl_target, _rl_before (words of the source before the row) and _rl_at (its place in the bucket)."""
    place = Window.partitionBy("_rl_rank", "_rl_bucket").orderBy("_rl_h", F.col("doc_id").asc_nulls_first(), "_rl_size", "_rl_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = buckets.withColumnRenamed("_rl_source", "_rl_source_b").withColumnRenamed("_rl_bucket", "_rl_bucket_b")
    return (
        rows.join(b, F.col("_rl_source").eqNullSafe(F.col("_rl_source_b")) & (F.col("_rl_bucket") == F.col("_rl_bucket_b"))).drop("_rl_source_b", "_rl_bucket_b")
        .withColumn("_rl_before", F.col("_rl_base") + F.sum("_rl_size").over(place) - F.col("_rl_size"))
        .withColumn("_rl_at", F.row_number().over(place))
    )


def copies(queue: DataFrame, s: Settings) -> DataFrame:
    """A row for each pass over each document, with its virtual finish time and slot."""
    finish = (F.col("_rl_copy") * F.col("_rl_source_size") + F.col("_rl_before") + F.col("_rl_size")) / F.col("_rl_target")
    return (
        queue.where("_rl_size > 0").withColumn("_rl_copy", F.explode(F.sequence(F.lit(0), F.lit(s.repeats - 1))))
        .withColumn("_rl_virtual_finish", finish)
        .withColumn("_rl_slot", F.least(F.floor(F.col("_rl_virtual_finish") * s.slots), F.lit(s.last_slot)))
    )


def mix(docs: DataFrame, s: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(every row of ``docs`` with its queue columns, the copies that the mix takes with all columns).

    The second is not yet in order; ``ordered`` sorts it by virtual finish time.
    """
    s = s or Settings()
    rows = sized(docs, s)
    light = durable(rows.select("doc_id", "_rl_source", "_rl_size", "_rl_h", "_rl_bucket", "_rl_tie"))
    # source totals and the words of each source before each of its buckets
    before = Window.partitionBy("_rl_source").orderBy("_rl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy("_rl_source", "_rl_bucket").agg(F.sum("_rl_size").alias("_rl_size"))
    goal = targets(sums, s).withColumnRenamed("_rl_source", "_rl_name")
    buckets = durable(
        sums.withColumn("_rl_base", F.coalesce(F.sum("_rl_size").over(before), F.lit(0)))
        .join(goal, F.col("_rl_source").eqNullSafe(F.col("_rl_name")))
        .select("_rl_source", "_rl_bucket", "_rl_base", "_rl_rank", "_rl_source_size", "_rl_target")
    )
    # at most last_slot + 1 rows
    slots = copies(queued(light, buckets, s), s).groupBy("_rl_slot").agg(F.sum("_rl_size").alias("_rl_words"))
    budget = F.lit(light.agg(F.coalesce(F.sum("_rl_size"), F.lit(0))).first()[0])  # one number
    cut = (
        slots.withColumn("_rl_until", F.sum("_rl_words").over(Window.orderBy("_rl_slot")))
        .where(F.col("_rl_until") - F.col("_rl_words") < budget)
        .select("_rl_slot", (budget - (F.col("_rl_until") - F.col("_rl_words"))).alias("_rl_left"), (F.col("_rl_until") > budget).alias("_rl_last"))
    )
    queue = queued(rows, buckets, s)
    order = Window.partitionBy("_rl_slot").orderBy("_rl_virtual_finish", "_rl_rank", "_rl_h", "_rl_at", "_rl_copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = copies(queue, s).join(F.broadcast(durable(cut)), "_rl_slot")
    whole = found.where(~F.col("_rl_last")).drop("_rl_left", "_rl_last")
    part = found.where("_rl_last").withColumn("_rl_sum", F.sum("_rl_size").over(order)).where("_rl_sum <= _rl_left").drop("_rl_left", "_rl_last", "_rl_sum")
    return queue, whole.unionByName(part)


def ordered(taken: DataFrame, columns: list[str]) -> DataFrame:
    """The mix in the order in which it is to be read: ``columns``, copy and virtual_finish (in place of any of that name), range-sorted."""
    return taken.orderBy("_rl_virtual_finish", "_rl_rank", "_rl_h", "_rl_at", "_rl_copy").select(
        *(c for c in columns if c.lower() not in ("copy", "virtual_finish")), F.col("_rl_copy").alias("copy"), F.col("_rl_virtual_finish").alias("virtual_finish")
    )


def mixed_sizes(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    queue, taken = mix(docs.select("doc_id", "source", "text"), s)
    key = ["_rl_rank", "_rl_bucket", "_rl_at"]
    n = taken.groupBy(*key).agg(F.count("*").alias("copies"))
    return (
        queue.drop("text").join(n, key, "left")
        .select("doc_id", F.col("_rl_size").alias("size"), F.col("_rl_source_size").alias("source_size"), F.col("_rl_target").alias("target"), (F.coalesce("copies", F.lit(0)) * F.col("_rl_size")).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"))
    )
