import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import order


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_positions_are_those_of_a_sort(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, rng.randrange(50)]), i) for i in range(300)]
    got = order.positions(spark.createDataFrame(rows, "k int, i int").repartition(3), F.asc_nulls_first("k"), "i", parts=parts).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r._at)] == want and sorted(r._at for r in got) == list(range(300))


def test_one_key_is_cut_over_ranges(spark):
    cut = order.ranged(spark.range(2000).select(F.lit(1).alias("k")).repartition(4), "k", parts=8)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1000 and sum(sizes) == 2000


@pytest.mark.parametrize("parts", [1, 4])
def test_ranks_are_those_of_windows(spark, parts):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.choice([None, 1.5, 1.5, rng.random()]), rng.randrange(4)) for _ in range(400)], "a double, b int")
    df.createOrReplaceTempView("ranked_rows")
    want = spark.sql("select distinct a, b, rank() over (order by a desc nulls last, b nulls first) rank, dense_rank() over (order by a desc nulls last, b nulls first) dense_rank from ranked_rows")
    got = order.ranks(df, {"a": True, "b": False}, parts)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_empty(spark):
    none = spark.createDataFrame([], "k int")
    assert order.positions(none, "k").count() == 0 and order.ranks(none, {"k": False}).count() == 0
