import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.quantile import quantile


@pytest.mark.parametrize("small", [1, 7, 100_000])
def test_same_as_sorting(spark, small):
    rng = random.Random(small)
    for values in ([5.0], [1.0, 1.0, 1.0, 2.0], [rng.gauss(0, 1) for _ in range(301)], [rng.choice([0.0, 0.0, -1.5, 3.0]) for _ in range(90)], [10.0 ** rng.randrange(-300, 300) for _ in range(60)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "x double").repartition(3)
        for q in (0.0, 0.37, 0.95, 1.0):
            assert quantile(df, "x", q, small) == pytest.approx(float(np.quantile(values, q)), rel=1e-12), (values, q)


def test_same_as_percentile(spark):
    df = spark.range(20_000).select((F.xxhash64("id") % 5000 / 7).alias("x"))
    for q in (0.01, 0.5, 0.99):
        assert quantile(df, "x", q, 50) == df.agg(F.percentile("x", F.lit(q))).first()[0]


def test_a_value_that_nearly_all_rows_have(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 3, -1.0).when(F.col("id") > 29_990, F.col("id").cast("double")).otherwise(7.0).alias("x"))
    assert quantile(df, "x", 0.5, 10) == 7.0 and quantile(df, "x", 0.0, 10) == -1.0 and quantile(df, "x", 1.0, 10) == 29_999.0


def test_odd_values(spark):
    assert quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None
    assert quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),)], "x double")
    assert quantile(df, "x", 0.5, 1) == 1.0 and math.isnan(quantile(df, "x", 1.0, 1)) and quantile(df, "x", 0.0, 1) == -math.inf
    with pytest.raises(ValueError):
        quantile(df, "x", 2)
