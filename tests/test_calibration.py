import datetime as dt
import random

import pytest

from riskloom.operators import calibration as cal
from riskloom.sources import sinks

SCHEMA = "y_true int, y_score double"


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(42)
    rows = [(0, rng.uniform(0, 50)) for _ in range(900)] + [(1, rng.uniform(50, 100)) for _ in range(100)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_separable(separable):
    best = cal.optimal_threshold(separable).first()
    assert best.fpr <= 0.02 and best.tpr == 1
    areas = cal.auc_ap(separable).first()
    assert areas.roc_auc == pytest.approx(1) and areas.average_precision == pytest.approx(1)
    report = cal.report(separable)
    assert set(report.summary.columns) == {"optimal_threshold", "max_fpr_constraint", "fpr", "tpr", "fnr", "roc_auc", "average_precision", "model_version"}
    assert report.roc.count() >= 3


def test_curves_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), float(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert cal.auc_ap(df).first().roc_auc == pytest.approx(area)
    points = cal.roc_curve(df).collect()
    assert points[0].threshold == float("inf")
    for r in points[1:]:
        assert r.tpr == pytest.approx(sum(p >= r.threshold for p in pos) / len(pos))
        assert r.fpr == pytest.approx(sum(n >= r.threshold for n in neg) / len(neg))
    assert cal.pr_curve(df).count() == len({s for _, s in rows}) + 1
    for t in (0.0, 10.0, 29.5):
        r = cal.rates_at(df, t).first()
        assert (r.fpr, r.fnr) == (pytest.approx(sum(n >= t for n in neg) / len(neg)), pytest.approx(sum(p < t for p in pos) / len(pos)))


def test_collinear_points_are_dropped(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 4.0), (1, 3.0), (0, 2.0), (0, 1.0)], SCHEMA)
    assert sorted(r.threshold for r in cal.roc_curve(df).collect()) == [1, 3, 5, float("inf")]


def test_one_class(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], SCHEMA)
    r = cal.rates_at(df, 1.5).first()
    assert (r.fpr, r.fnr) == (0.5, 0)
    assert cal.optimal_threshold(df).first().threshold == float("inf")


@pytest.mark.parametrize("args, want", [((50, 0.04, 0.02), 52), ((50, 0.01, 0.02), 49), ((50, 1, 0.01), 55), ((1, 0, 0.01), 0), ((99, 1, 0.01), 100)])
def test_auto_adjust(args, want):
    assert cal.auto_adjust(*args) == pytest.approx(want)


def test_adjusted_is_auto_adjust_for_rows(spark):
    cases = [(c, o) for c in (0.0, 1.0, 50.0, 99.0, 100.0) for o in (0.0, 0.01, 0.02, 0.03, 0.5)]
    df = spark.createDataFrame([*cases, (None, 0.1), (5.0, None)], "c double, o double")
    got = {(r.c, r.o): r.x for r in df.withColumn("x", cal.adjusted(df.c, df.o, 0.02)).collect()}
    assert got == {k: cal.auto_adjust(*k, 0.02) for k in cases} | {(None, 0.1): None, (5.0, None): None}
    with pytest.raises(ValueError):
        cal.adjusted(df.c, df.o, 0)


def test_auto_adjust_rejects_a_target_of_zero():
    with pytest.raises(ValueError):
        cal.auto_adjust(50, 0.1, 0)


def test_threshold_sinks(spark):
    row = sinks.threshold_row(spark, "m", 71.23456, 0.01, 0.2, dt.datetime(2024, 1, 1), threshold_id=1).first()
    assert str(row.threshold_value) == "71.2346" and row.updated_by == "threshold_calibrator"
    sql = sinks.threshold_insert_sql("o'x", 71.23456, 0.01, 0.2)
    assert sql.startswith("INSERT INTO threshold_history") and "'o''x'" in sql and "71.234560" in sql
