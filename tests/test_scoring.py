import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import registry
from riskloom.config import AnomalyParams, Config, ModelParams
from riskloom.operators import features, iforest, scoring
from riskloom.sources import sinks

SCHEMA = "event_id long, user_id string, ip_address string, device_id string, session_id string, action string, timestamp timestamp_ntz, enforced int"
T0 = dt.datetime(2024, 1, 1)
SMALL = Config(model=ModelParams(n_estimators=40))


def users(bad=True):
    rng = random.Random(7)
    rows = []
    for u in range(60):
        for i in range(20):
            rows.append((len(rows), f"ok{u}", f"10.0.{rng.randrange(5)}.{rng.randrange(255)}", f"d{u}_{rng.randrange(2)}", "s", rng.choice("abc"), T0 + dt.timedelta(minutes=2 * i + rng.random()), int(rng.random() < 0.05)))
    for u in range(5 if bad else 0):
        for i in range(200):
            rows.append((len(rows), f"bad{u}", f"192.168.0.{rng.randrange(3)}", f"shared{rng.randrange(2)}", "s", "a", T0 + dt.timedelta(seconds=i), 1))
    return rows


@pytest.fixture(scope="module")
def matrix(spark):
    return features.feature_matrix(spark.createDataFrame(users(), SCHEMA)).cache()


@pytest.fixture(scope="module")
def model(matrix):
    return scoring.RiskModel.fit(matrix, SMALL)


def test_scores_and_ranking(model, matrix):
    got = model.predict(matrix).toPandas()
    assert len(got) == 65 and got["risk_score"].between(0, 100).all()
    bad = got["user_id"].str.startswith("bad")
    assert got[bad]["risk_score"].mean() > got[~bad]["risk_score"].mean() + 20
    assert got["risk_score"].is_monotonic_decreasing
    assert got["isolation_score"].max() == 1 and got["isolation_score"].min() == 0


def test_threshold_never_below_the_floor(model):
    assert model.threshold >= 70


def test_reruns_agree(model, matrix):
    again = scoring.RiskModel.fit(matrix, SMALL).predict(matrix).toPandas()
    assert again.equals(model.predict(matrix).toPandas())


def test_unfitted(matrix):
    with pytest.raises(RuntimeError):
        scoring.RiskModel().predict(matrix)


def test_save_and_load(spark, model, matrix, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    loaded = scoring.RiskModel.load(spark, str(tmp_path / "m"))
    assert loaded.predict(matrix).toPandas().equals(model.predict(matrix).toPandas())


def test_alignment(model, matrix):
    got = model.predict(matrix.drop("ip_entropy").withColumn("new_one", F.lit(1.0)))
    assert got.count() == 65


def test_training_range_is_stateless(model, matrix):
    one = matrix.where("user_id = 'bad0'")
    assert model.predict(one, "train").first()["risk_score"] > 50
    assert model.predict(one, "batch").first()["isolation_score"] == 0  # a batch of one has no range


def test_baselines_of_a_constant_column(spark):
    row = scoring.baselines(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "user_id string, x double"), ["x"]).first()
    assert tuple(row) == (1.0, 1.0)


def test_zscores_use_the_population_deviation(spark):
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([0] * 9 + [10])], "user_id string, x double")
    got = {r.user_id: r.zscore_share for r in scoring.zscores(df, ["x"], AnomalyParams(zscore_threshold=2.9)).collect()}
    assert got["9"] == 1 and sum(got.values()) == 1  # z is exactly 3


def test_forest_depths():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(200, 3)), [[9, 9, 9]]]
    nodes = [iforest.grow(x[rng.choice(201, 64, replace=False)], rng, 6) for _ in range(50)]
    import pandas as pd

    table = pd.DataFrame([(t, i, *n) for t, tree in enumerate(nodes) for i, n in enumerate(tree)], columns=["tree", "node", "feature", "cut", "left", "right", "size"])
    scores = iforest.Forest.of(table, 64).score(x)
    assert scores.argmax() == 200 and 0 < scores.min() < scores.max() <= 1
    assert iforest.expected_depth(np.array([1, 2, 256]))[:2].tolist() == [0, 1]


def test_merge_keeps_rows(spark, model, matrix):
    events = spark.createDataFrame(users(), SCHEMA)
    merged = sinks.merge_scores(events, model.predict(matrix.where("user_id like 'ok%'")))
    assert merged.count() == events.count()
    assert merged.where("user_id like 'bad%' and (risk_score <> 0 or is_anomaly)").count() == 0


def test_registered_forest_has_all_trees(spark, data, monkeypatch):
    built, fit = [], iforest.fit
    monkeypatch.setattr(iforest, "fit", lambda scaled, columns, trees, *a: built.append(trees) or fit(scaled, columns, trees, *a))
    registry.QUERIES["score_iforest"](spark, data)
    assert built == [200]
