"""Alerts: candidates as frames, and the ordered fold of dedup, rate limit and dispatch.

A candidate has alert_type, entity, at (seconds) and details (JSON).  The fold
depends on the order: an alert is a duplicate of the last one *sent*, and the
rate limit is shared by all entities.  Candidates are filtered by their
thresholds in parallel, and folded in segments of time that are repaired until
their states fit.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AlertParams, AnomalyParams
from .durable import durable
from .order import ranged

CANDIDATE = "alert_type string, entity string, at double, details string"


def entity_of(details: dict) -> str:
    """The first of user_id, cluster_id, period that is given; 0 and the empty string count as given."""
    return next((str(details[k]) for k in ("user_id", "cluster_id", "period") if details.get(k) is not None), "global")


def _candidate(kind: str, entity: Column, details: Column, at: Column) -> list[Column]:
    return [F.lit(kind).alias("alert_type"), entity.cast("string").alias("entity"), at.cast("double").alias("at"), F.to_json(details).alias("details")]


def user_candidates(scores: DataFrame, p: AnomalyParams = AnomalyParams(), at: Column | None = None) -> DataFrame:
    """Users at risk_score_high or above."""
    details = F.struct("user_id", "risk_score", F.lit(p.risk_score_high).alias("threshold"))
    return scores.where(F.col("risk_score") >= p.risk_score_high).select(*_candidate("user_high_risk", F.col("user_id"), details, F.lit(0.0) if at is None else at))


def cluster_candidates(clusters: DataFrame, p: AnomalyParams = AnomalyParams(), at: Column | None = None) -> DataFrame:
    """Clusters (cluster_id, cluster_score) at risk_score_high or above; a score of 1 or less is taken as a share."""
    score = F.col("cluster_score")
    scaled = clusters.withColumn("normalised_score", F.when(score <= 1.0, score * 100.0).otherwise(score)).where(F.col("normalised_score") >= p.risk_score_high)
    details = F.struct("cluster_id", "cluster_score", "normalised_score", F.lit(p.risk_score_high).alias("threshold"))
    return scaled.select(*_candidate("cluster_high_risk", F.col("cluster_id"), details, F.lit(0.0) if at is None else at))


def spike(counts: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """The z-score of the last period against all before it: period, enforcement_count, rolling_mean, rolling_std, z_score, is_spike.

    ``counts`` has period and enforcement_count; ValueError for a missing column or fewer than two rows.
    """
    if "enforcement_count" not in counts.columns or "period" not in counts.columns:
        raise ValueError("period and enforcement_count are needed")
    if len(counts.head(2)) < 2:
        raise ValueError("at least two periods are needed")
    last = counts.agg(F.max_by(F.struct("period", "enforcement_count"), F.struct("period", "enforcement_count")).alias("x")).select("x.*", F.lit(1).alias("_one"))
    rest = counts.withColumn("_one", F.lit(1)).join(F.broadcast(last.select("_one", F.col("period").alias("_last"))), "_one").where(F.col("period") < F.col("_last"))
    stats = rest.agg(F.avg(F.col("enforcement_count").cast("double")).alias("m"), F.coalesce(F.stddev_samp(F.col("enforcement_count").cast("double")), F.lit(0.0)).alias("s")).withColumn("_one", F.lit(1))
    z = F.when(F.col("s") >= 1e-9, (F.col("enforcement_count") - F.col("m")) / F.when(F.col("s") >= 1e-9, F.col("s")).otherwise(1.0))
    return last.join(F.broadcast(stats), "_one").select(
        "period", "enforcement_count", F.bround("m", 2).alias("rolling_mean"), F.bround("s", 2).alias("rolling_std"), F.bround(z, 4).alias("z_score"),
        F.coalesce(z > p.zscore_threshold, F.lit(False)).alias("is_spike"),
    )


def spike_candidates(counts: DataFrame, p: AnomalyParams = AnomalyParams(), at: Column | None = None) -> DataFrame:
    found = spike(counts, p).where("is_spike").withColumn("threshold_z", F.lit(p.zscore_threshold))
    details = F.struct(F.col("period").cast("string").alias("period"), "enforcement_count", "rolling_mean", "rolling_std", "z_score", "threshold_z")
    return found.select(*_candidate("escalation_spike", F.col("period"), details, F.lit(0.0) if at is None else at))


@dataclass
class Dispatcher:
    """Dedup, then rate limit, then send; only a success marks the entity, is counted as sent and logged."""

    send: Callable[[dict], bool]
    params: AlertParams = field(default_factory=AlertParams)
    log: Callable[[str, dict, float], None] | None = None
    last_sent: dict[tuple[str, str], float] = field(default_factory=dict)
    recent: deque = field(default_factory=deque)
    metrics: dict[str, int] = field(default_factory=lambda: {"sent": 0, "deduplicated": 0, "failed": 0})

    def __call__(self, alert_type: str, details: dict, now: float, entity: str | None = None) -> str:
        """What became of the alert: sent, deduplicated, rate_limited or failed."""
        key = (alert_type, entity_of(details) if entity is None else entity)
        if key in self.last_sent and now - self.last_sent[key] < self.params.dedup_window_seconds:
            self.metrics["deduplicated"] += 1
            return "deduplicated"
        while self.recent and now - self.recent[0] >= 60.0:
            self.recent.popleft()
        if len(self.recent) >= self.params.rate_limit_per_minute:
            self.metrics["failed"] += 1
            return "rate_limited"
        self.recent.append(now)  # a place is used up whether or not sending succeeds
        if not self.send({"alert_type": alert_type, "timestamp": now, "details": details}):
            self.metrics["failed"] += 1
            return "failed"
        self.last_sent[key] = now
        self.metrics["sent"] += 1
        if self.log:
            self.log(alert_type, details, now)
        return "sent"


_STEP = f"_part long, _state boolean, {CANDIDATE}, outcome string"


def _segment(rows: pd.DataFrame, sent: pd.DataFrame, p: AlertParams) -> pd.DataFrame:
    """The outcomes of a segment after the alerts ``sent`` before it, then what it leaves: alerts that still count at its end."""
    keep = max(60.0, p.dedup_window_seconds)
    left = [(t, e, a) for a, t, e in sorted(zip(sent["at"], sent["alert_type"], sent["entity"], strict=True))]
    state = Dispatcher(lambda _: True, p, last_sent={(t, e): a for t, e, a in left}, recent=deque(a for *_, a in left))
    rows = rows.sort_values("_row")
    rows["outcome"] = [state(t, {}, a, e) for t, e, a in zip(rows["alert_type"], rows["entity"], rows["at"], strict=True)]
    new = rows.loc[rows["outcome"] == "sent", ["alert_type", "entity", "at"]]
    after = pd.concat([pd.DataFrame(left, columns=["alert_type", "entity", "at"]).astype({"at": float}), new], ignore_index=True)
    after = after[after["at"] > rows["at"].iloc[-1] - keep].assign(_state=True, details=None, outcome=None)
    out = pd.concat([rows.assign(_state=False).drop(columns="_row"), after], ignore_index=True)
    out["_part"] = rows["_part"].iloc[0]
    return out[["_part", "_state", "alert_type", "entity", "at", "details", "outcome"]].astype(object)


def fold(candidates: DataFrame, p: AlertParams = AlertParams(), per_segment: int = 20_000) -> DataFrame:
    """Candidates with ``outcome``, in order, as if each were sent successfully at its time; ties go by type and entity.

    Dedup and rate limit run over all candidates in order of time, but what counts of the past is only what was sent within
    the longer of the dedup window and a minute, which the rate limit bounds.  So time is cut into segments that are folded
    in parallel, first as if nothing had been sent before; then each gets what the segment before it leaves, and those that
    this changes are folded again, until none is.  The first segments are right after as many rounds, so this ends; usually
    it takes a few, since a segment forgets what came before it.
    """
    order = ["at", "alert_type", "entity", "details"]
    named = candidates.select("alert_type", "entity", F.col("at").cast("double").alias("at"), "details")
    laid = durable(named)
    cut = ranged(laid, *order, parts=max(1, math.ceil(laid.count() / per_segment)))
    parts = sorted(r._part for r in cut.select("_part").distinct().collect())  # a number for each segment
    none = cut.sparkSession.createDataFrame([], "_part long, alert_type string, entity string, at double")

    def run(segments: list[int], sent: DataFrame) -> DataFrame:
        rows = cut.where(F.col("_part").isin(segments)) if len(segments) < len(parts) else cut
        return durable(rows.groupBy("_part").cogroup(sent.groupBy("_part")).applyInPandas(lambda r, s: _segment(r, s, p) if len(r) else pd.DataFrame(columns=["_part", "_state", *order, "outcome"]), _STEP))

    def left(done: DataFrame) -> dict[int, str]:
        state = F.sort_array(F.collect_list(F.struct("at", "alert_type", "entity")))
        return {r._part: r.digest for r in done.where("_state").groupBy("_part").agg(F.sha2(F.to_json(state), 256).alias("digest")).collect()}

    following = dict(zip(parts, parts[1:], strict=False))
    after = F.create_map(*(F.lit(x).cast("long") for pair in following.items() for x in pair)) if following else None
    done = run(parts, none) if parts else None
    given = dict.fromkeys(parts, "")
    while following:
        leaves = left(done)
        now = {p_: leaves.get(before, "") for before, p_ in following.items()}
        stale = [p_ for p_, digest in now.items() if digest != given[p_]]
        if not stale:
            break
        given |= now
        sent = done.where("_state").select(F.element_at(after, F.col("_part")).alias("_part"), "alert_type", "entity", "at").where(F.col("_part").isin(stale))
        done = durable(done.where(~F.col("_part").isin(stale)).unionByName(run(stale, sent)))
    if done is None:
        return named.withColumn("outcome", F.lit(None).cast("string"))
    return done.where(~F.col("_state")).select("alert_type", "entity", "at", "details", "outcome").orderBy(*order)
