"""Anomaly scores of 0 to 100: z-score share and isolation forest, blended; threshold; model storage."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnomalyParams, Config, ModelParams
from . import iforest
from .durable import durable
from .quantile import quantile, written


def baselines(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``<c>_mean`` and ``<c>_std`` (population; 1 for a constant column)."""
    mean = [F.avg(c).alias(f"{c}_mean") for c in columns]
    std = [F.when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) > 1e-9, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_std") for c in columns]
    return features.agg(*mean, *std)


def zscore_share(columns: list[str], stats: dict[str, tuple[Column, Column]], limit: float) -> Column:
    """The share of features whose absolute z-score exceeds ``limit``."""
    over = [F.when(F.abs((F.col(c) - stats[c][0]) / stats[c][1]) > limit, 1.0).otherwise(0.0) for c in columns]
    return sum(over[1:], over[0]) / F.lit(float(len(columns)))


def zscores(features: DataFrame, columns: list[str], p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """user_id and zscore_share against the baselines of the same frame."""
    joined = features.withColumn("_one", F.lit(1)).join(F.broadcast(baselines(features, columns).withColumn("_one", F.lit(1))), "_one")  # one row
    stats = {c: (F.col(f"{c}_mean"), F.col(f"{c}_std")) for c in columns}
    return joined.select("user_id", zscore_share(columns, stats, p.zscore_threshold).alias("zscore_share"))


def blend(isolation: Column, zscore: Column, p: AnomalyParams = AnomalyParams()) -> Column:
    total = (F.lit(p.isolation_weight) * isolation + F.lit(p.zscore_weight) * zscore) * 100
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)).cast("float")


def calibrated_threshold(scores: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """One row: threshold, the exact quantile at 1 - target_fpr but never below risk_score_high.

    The quantile is selected at once, in passes over the scores alone, which are written for it.
    """
    found = quantile(written(scores, "risk_score"), "risk_score", 1 - p.target_fpr)
    value = F.lit(found).cast("double")
    return scores.sparkSession.range(1).select(value.alias("quantile"), F.greatest(value, F.lit(p.risk_score_high)).alias("threshold"))


def align(features: DataFrame, columns: list[str]) -> DataFrame:
    """user_id and ``columns``; one that is absent, and any null, is 0."""
    have = set(features.columns)
    return features.select("user_id", *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in columns))


@dataclass
class RiskModel:
    """A fitted model.  ``predict`` scales forest scores by the range of the batch or, with normalize='train', of the training set."""

    columns: list[str] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)
    threshold: float | None = None
    train_range: tuple[float, float] = (0.0, 0.0)
    psi: int = 0
    params: AnomalyParams = field(default_factory=AnomalyParams)
    model: ModelParams = field(default_factory=ModelParams)
    forest: iforest.Forest | None = None

    @classmethod
    def fit(cls, features: DataFrame, config: Config = Config()) -> RiskModel:
        """Fits on a feature matrix (user_id and numeric columns)."""
        features = durable(features)  # read for the baselines, the sample and the scores
        columns = [c for c in features.columns if c != "user_id"]
        row = baselines(features, columns).first()
        self = cls(columns, [row[f"{c}_mean"] for c in columns], [row[f"{c}_std"] for c in columns], params=config.anomaly_detection, model=config.model)
        if self.mean[0] is None:
            raise ValueError("no rows to fit on")
        nodes, self.psi = iforest.fit(self._scaled(features), columns, config.model.n_estimators, config.model.max_samples, config.anomaly_detection.random_state)
        self.forest = iforest.Forest.of(nodes.toPandas(), self.psi)  # at most trees * (2 * samples - 1) nodes
        raw = durable(self._raw(features))  # read for the range and the threshold
        low, high = raw.agg(F.min("raw"), F.max("raw")).first()
        self.train_range = (low, high)
        self.threshold = calibrated_threshold(self._blended(raw, F.lit(low), F.lit(high)), self.params).first()["threshold"]
        return self

    def _scaled(self, features: DataFrame) -> DataFrame:
        aligned = align(features, self.columns)
        return aligned.select("user_id", *(((F.col(c) - m) / s).alias(c) for c, m, s in zip(self.columns, self.mean, self.std, strict=True)))

    def _raw(self, features: DataFrame) -> DataFrame:
        """user_id, zscore_share, raw: all that scores need, without the features."""
        share = zscore_share(self.columns, {c: (F.lit(0.0), F.lit(1.0)) for c in self.columns}, self.params.zscore_threshold)
        return iforest.score(self._scaled(features), self.columns, self.forest).select("user_id", share.alias("zscore_share"), "raw")

    def _blended(self, raw: DataFrame, low: Column, high: Column) -> DataFrame:
        isolation = F.when(high - low < 1e-9, 0.0).otherwise((F.col("raw") - low) / F.when(high - low < 1e-9, 1.0).otherwise(high - low))
        return raw.select("user_id", "zscore_share", isolation.alias("isolation_score"), blend(isolation, F.col("zscore_share"), self.params).alias("risk_score"))

    def predict(self, features: DataFrame, normalize: str = "batch") -> DataFrame:
        """user_id, zscore_share, isolation_score, risk_score (float), is_anomaly; highest first."""
        if self.forest is None or self.threshold is None:
            raise RuntimeError("the model is not fitted")
        raw = self._raw(features)
        if normalize == "batch":
            raw = durable(raw)  # read for the range and the scores
            ends = raw.agg(F.min("raw").alias("_low"), F.max("raw").alias("_high")).withColumn("_one", F.lit(1))
            raw = raw.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")  # one row
            scored = self._blended(raw, F.col("_low"), F.col("_high"))
        else:
            scored = self._blended(raw, *(F.lit(x) for x in self.train_range))
        return scored.withColumn("is_anomaly", F.col("risk_score") >= F.lit(self.threshold).cast("float")).orderBy(F.desc("risk_score"), "user_id")

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet, all else as one JSON line, both through Spark."""
        if self.forest is None:
            raise RuntimeError("the model is not fitted")
        rows = [(k, i, *(t[c][i].item() for c in ("feature", "cut", "left", "right", "size"))) for k, t in enumerate(self.forest.trees) for i in range(len(t["cut"]))]
        spark.createDataFrame(rows, iforest.NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        facts = {"columns": self.columns, "mean": self.mean, "std": self.std, "threshold": self.threshold, "train_range": self.train_range, "psi": self.psi, "params": asdict(self.params), "model": asdict(self.model)}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        params, model = AnomalyParams(**facts.pop("params")), ModelParams(**facts.pop("model"))
        facts["train_range"] = tuple(facts["train_range"])
        nodes = spark.read.schema(iforest.NODES).parquet(f"{path}/nodes").toPandas()
        return cls(**facts, params=params, model=model, forest=iforest.Forest.of(nodes, facts["psi"]))
