"""Threshold calibration over a frame of (y_true 0/1, y_score double).

All curves come from one aggregation by distinct score: running sums over the
scores in descending order, made in two steps (ranges of about as many scores
each, then within a range), so that no task holds the whole curve.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates_at(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: threshold, fpr, fnr (positive means score >= threshold; 0 for an absent class)."""
    hit, pos = F.col("y_score") >= threshold, F.col("y_true") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = scored.agg(n(hit & ~pos).alias("fp"), n(~pos).alias("neg"), n(~hit & pos).alias("fn"), n(pos).alias("pos"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.greatest(F.col(b), F.lit(1))).otherwise(0.0)
    return sums.select(F.lit(float(threshold)).alias("threshold"), rate("fp", "neg").alias("fpr"), rate("fn", "pos").alias("fnr"))


def cumulative(scored: DataFrame, ranges: int = 256) -> DataFrame:
    """For every distinct score: threshold, tp, fp (rows at or above it, by class), p, n (rows at it), p_next, n_next (rows at
    the next lower score; null for the last), tot_pos, tot_neg.

    Scores are cut into ranges of about equal numbers; only sums and ends of ranges are ever in one task.
    """
    per = scored.groupBy(F.col("y_score").cast("double").alias("threshold")).agg(F.sum(F.col("y_true").cast("long")).alias("p"), F.sum((1 - F.col("y_true")).cast("long")).alias("n"))
    cuts = [i / ranges for i in range(1, ranges)]
    ends = per.agg(F.percentile_approx("threshold", F.array(*(F.lit(c) for c in cuts)), F.lit(10 * ranges)).alias("_cuts"), F.sum("p").alias("tot_pos"), F.sum("n").alias("tot_neg")).withColumn("_one", F.lit(1))
    ranged = per.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one").withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col("threshold")))).drop("_cuts", "_one")
    order = Window.orderBy("_range")  # at most ``ranges`` rows
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max_by(F.struct("p", "n"), "threshold")
    sums = ranged.groupBy("_range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"), top.alias("top"))
    before = sums.select("_range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.lead("top").over(order).alias("below"))
    place = Window.partitionBy("_range").orderBy(F.desc("threshold"))
    inner = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = lambda c: F.coalesce(F.lead(c).over(place), F.col(f"below.{c}")).alias(f"{c}_next")
    return ranged.join(F.broadcast(before), "_range").select(
        "threshold", (F.col("bp") + F.sum("p").over(inner)).alias("tp"), (F.col("bn") + F.sum("n").over(inner)).alias("fp"), "p", "n", after("p"), after("n"), "tot_pos", "tot_neg"
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """threshold, fpr, tpr: from (inf, 0, 0) down; inner points on a straight line are left out."""
    c = cumulative(scored)
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    # as many rows of a class at the next score as at this one: no bend
    bend = (F.col("p_next") != F.col("p")) | (F.col("n_next") != F.col("n"))
    kept = c.where(first | F.col("p_next").isNull() | bend)
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.greatest(F.col(n), F.lit(1)))
    points = kept.select("threshold", share("fp", "tot_neg").alias("fpr"), share("tp", "tot_pos").alias("tpr"))
    first = c.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return first.unionByName(points)


def pr_curve(scored: DataFrame) -> DataFrame:
    """threshold (null for the last point), precision, recall, by rising threshold; the last point is (1, 0)."""
    c = cumulative(scored)
    recall = F.when(F.col("tot_pos") > 0, F.col("tp") / F.greatest(F.col("tot_pos"), F.lit(1))).otherwise(1.0)
    points = c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"))
    last = c.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(last)


def auc_ap(scored: DataFrame) -> DataFrame:
    """One row: roc_auc (trapezoids, ties grouped) and average_precision (steps)."""
    c = cumulative(scored).withColumn("tp0", F.col("tp") - F.col("p")).withColumn("fp0", F.col("fp") - F.col("n"))
    area = F.sum((F.col("fp") - F.col("fp0")).cast("double") * (F.col("tp") + F.col("tp0"))) / 2 / F.nullif(F.max(F.col("tot_pos").cast("double") * F.col("tot_neg")), F.lit(0.0))
    steps = F.sum((F.col("tp") - F.col("tp0")).cast("double") / F.nullif(F.col("tot_pos"), F.lit(0)) * (F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))))
    return c.agg(area.alias("roc_auc"), F.coalesce(steps, F.lit(0.0)).alias("average_precision"))


def optimal_threshold(scored: DataFrame, max_fpr: float = 0.02) -> DataFrame:
    """One row: threshold, fpr, tpr of the point with the largest tpr among those with fpr <= max_fpr, the highest threshold of equals.

    Without such a point (one class only), the one with the smallest fpr.
    """
    points = roc_curve(scored)
    fits = F.coalesce(F.col("fpr") <= max_fpr, F.lit(False))
    return points.orderBy(F.desc(fits), F.when(fits, F.col("tpr")).desc_nulls_last(), F.when(~fits, F.col("fpr")).asc_nulls_last(), F.desc("threshold")).limit(1)


def auto_adjust(current: float, observed_fpr: float, target_fpr: float) -> float:
    """The threshold moved by twice the relative excess, by 5 at most, kept within 0 and 100; it moves both ways."""
    if target_fpr <= 0:
        raise ValueError("target_fpr must be positive")
    step = max(-5.0, min(5.0, (observed_fpr - target_fpr) / target_fpr * 2))
    return max(0.0, min(100.0, current + step))


def adjusted(current: Column, observed_fpr: Column, target_fpr: float) -> Column:
    """``auto_adjust`` as an expression, for thresholds that are rows; null where either is."""
    if target_fpr <= 0:
        raise ValueError("target_fpr must be positive")
    bounded = lambda x, low, high: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
    step = bounded((observed_fpr - F.lit(target_fpr)) / F.lit(target_fpr) * F.lit(2.0), -5.0, 5.0)
    return bounded(current + step, 0.0, 100.0)


@dataclass
class Report:
    """A one-row summary and the two curves, which stay frames."""

    summary: DataFrame
    roc: DataFrame
    pr: DataFrame


def report(scored: DataFrame, target_fpr: float = 0.01, model_version: str = "1.0.0") -> Report:
    best = optimal_threshold(scored, target_fpr).withColumn("_one", F.lit(1))
    areas = auc_ap(scored).withColumn("_one", F.lit(1))
    six = lambda c: F.bround(c, 6).alias(c)
    summary = best.join(F.broadcast(areas), "_one").select(  # one row each
        six("threshold").alias("optimal_threshold"), F.lit(target_fpr).alias("max_fpr_constraint"), six("fpr"), six("tpr"),
        F.bround(1 - F.col("tpr"), 6).alias("fnr"), six("roc_auc"), six("average_precision"), F.lit(model_version).alias("model_version"),
    )
    return Report(summary, roc_curve(scored), pr_curve(scored))
