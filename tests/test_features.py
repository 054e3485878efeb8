import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.config import Config, FeatureParams, from_dict, load
from riskloom.operators import features
from riskloom.sources import events as ev

SCHEMA = "event_id long, user_id string, ip_address string, device_id string, session_id string, action string, timestamp timestamp_ntz, enforced int"
T0 = dt.datetime(2024, 1, 1)


def log(n=1000, users=100, seed=42):
    rng = random.Random(seed)
    return [(i, f"u{rng.randrange(users)}", f"ip{rng.randrange(50)}", f"d{rng.randrange(30)}", f"s{rng.randrange(200)}", rng.choice("abcde"), T0 + dt.timedelta(minutes=i), rng.randrange(2)) for i in range(n)]


@pytest.fixture(scope="module")
def matrix(spark):
    return features.feature_matrix(spark.createDataFrame(log(), SCHEMA)).toPandas().set_index("user_id")


def test_columns(matrix):
    assert list(matrix.columns) == features.feature_names()
    assert len(matrix.columns) == 16


def test_all_users_and_no_nulls(matrix):
    assert set(matrix.index) == {r[1] for r in log()}
    assert not matrix.isna().any().any()


def test_ranges(matrix):
    assert (matrix["ip_entropy"] <= math.log2(50) + 1e-9).all() and (matrix["ip_entropy"] >= 0).all()
    assert matrix["device_reuse_score"].between(0, 1).all() and matrix["device_reuse_score"].max() == 1
    assert (matrix["session_velocity_mean"] >= 0).all()
    assert matrix["enforcement_rate"].between(0, 1).all()


def test_rolling_counts_equal_pandas_with_ties(spark):
    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(5)}", None, None, "s", None if rng.random() < 0.05 else "a", T0 + dt.timedelta(minutes=rng.randrange(200)), 0) for i in range(600)]
    got = features.action_frequency(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("user_id")
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).sort_values(["user_id", "timestamp", "event_id"])
    for user, part in pdf.groupby("user_id"):
        one = part.set_index("timestamp")["action"].notna().astype(float).where(lambda x: x > 0)
        for w in (5, 15, 60):
            counts = one.rolling(f"{w}min").count()
            assert got.loc[user, f"action_freq_{w}m_mean"] == pytest.approx(counts.mean())
            assert got.loc[user, f"action_freq_{w}m_max"] == counts.max()


def test_window_is_open_at_its_start(spark):
    rows = [(i, "u", "i", "d", "s", "a", T0 + dt.timedelta(minutes=m), 0) for i, m in enumerate((0, 5, 5))]
    row = features.action_frequency(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row["action_freq_5m_mean"], row["action_freq_5m_max"]) == (pytest.approx(4 / 3), 2)


def test_sessions_split_only_above_the_gap(spark):
    rows = [(i, "u", "i", "d", "s", "a", T0 + dt.timedelta(minutes=m, seconds=s), 0) for i, (m, s) in enumerate(((0, 0), (30, 0), (60, 1)))]
    row = features.session_velocity(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["session_count"] == 2
    assert row["session_velocity_max"] == pytest.approx(1 / 1800)


def test_velocity_is_capped(spark):
    rows = [(i, "u", "i", "d", "s", "a", T0 + dt.timedelta(microseconds=i), 0) for i in range(10)]
    assert features.session_velocity(spark.createDataFrame(rows, SCHEMA)).first()["session_velocity_max"] == 1000


def test_entropy_counts_missing_addresses_in_the_total(spark):
    rows = [(i, "u", ip, "d", "s", "a", T0 + dt.timedelta(minutes=i), 0) for i, ip in enumerate(("x", "y", None, None))]
    row = features.ip_entropy(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["ip_entropy"] == pytest.approx(1.0) and row["unique_ip_count"] == 2
    assert features.ip_entropy(spark.createDataFrame(rows[:2], SCHEMA)).first()["ip_entropy"] == 0


def test_without_enforced(spark):
    row = features.enforcement_rate(spark.createDataFrame(log(50), SCHEMA).drop("enforced")).agg(F.max("enforcement_rate"), F.sum("total_events")).first()
    assert tuple(row) == (0, 50)


def test_validation(spark):
    df = spark.createDataFrame(log(5), SCHEMA)
    with pytest.raises(ValueError, match="ip_address"):
        ev.validate(df.drop("ip_address"))
    with pytest.raises(ValueError, match="no events"):
        ev.validate(df.where("false"), check_empty=True)


def test_normalise_keeps_the_first_and_casts(spark):
    rows = [(2, "u", "b", "d", "s", "a", T0, "true"), (1, "u", "a", "d", "s", "a", T0, "x"), (3, "u", "c", "d", "s", "b", T0, None)]
    got = ev.normalise(spark.createDataFrame(rows, SCHEMA.replace("enforced int", "enforced string"))).orderBy("event_id").collect()
    assert [(r.event_id, r.ip_address, r.enforced) for r in got] == [(1, "a", 0), (3, "c", 0)]


def test_event_log_prunes_months(spark, tmp_path):
    rows = [(i, "u", T0 + dt.timedelta(days=20 * i)) for i in range(6)]
    ev.write_events(spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz"), str(tmp_path / "log"))
    got = ev.read_events(spark, str(tmp_path / "log"), dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 29))
    assert sorted(r.event_id for r in got.collect()) == [2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_config(tmp_path):
    c = from_dict({"anomaly_detection": {"zscore_threshold": 2.5, "isolation_forest_weight": 0.5}, "feature_engineering": {"rolling_windows": [1, 2]}, "model": {"max_samples": "auto"}, "logging": {}})
    assert (c.anomaly_detection.zscore_threshold, c.anomaly_detection.isolation_weight, c.feature_engineering.windows, c.model.max_samples) == (2.5, 0.5, (1, 2), 256)
    assert Config().feature_engineering == FeatureParams()
    with pytest.raises(FileNotFoundError):
        load(tmp_path / "none.yaml")
