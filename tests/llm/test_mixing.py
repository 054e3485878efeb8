import hashlib
import random

import pytest
from corpus_text import prose
from pyspark.sql import functions as F

from riskloom.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by the contract's words: share, stop at the limit, share the excess anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: repeats * sizes[s] for s in over}


def build(spark, sizes, rng, words=8):
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), prose(rng, rng.randrange(1, 2 * words)), "en", source, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("counts", [{"a": 300, "b": 40, "c": 100, None: 5}, {"z": 10, "y": 200, "x": 1}, {"one": 50}])
def test_targets_and_taken(spark, rng, counts):
    docs = build(spark, counts, rng)
    got = mixing.mixed_sizes(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = waterfill(sizes)
    assert len(got) == docs.count()
    for source, target in want.items():
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]}
        assert mine[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in mine) - target) <= 40
        assert all(r.taken in {k * r.size for k in range(4)} for r in mine)
    assert sum(r.taken for r in got) <= sum(sizes.values())


def test_queue_by_definition(spark, rng):
    docs = build(spark, {"a": 60, "b": 30, "c": 200}, rng)
    rows = [(r.doc_id, r.source, len(r.text.split())) for r in docs.collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, queue = waterfill(sizes), []
    for s in sizes:
        mine = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, n) for d, x, n in rows if x == s)
        at = 0
        for copy in range(3):
            for h, d, n in mine:
                at += n
                queue.append((at / target[s], s, h, d, copy, n))
    total, taken = 0, {}
    for _, _, _, d, _, n in sorted(queue):
        total += n
        if total > sum(sizes.values()):
            break
        taken[d] = taken.get(d, 0) + n
    assert {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect()} == {d: taken.get(d, 0) for d, _, _ in rows}


def test_order_and_columns_of_the_mix(spark, rng):
    docs = build(spark, {"a": 30, "b": 5}, rng).withColumn("_size", F.lit("mine")).withColumn("target", F.lit("mine"))
    out = mixing.ordered(mixing.mix(docs)[1], docs.columns)
    got = out.collect()
    assert [r.virtual_finish for r in got] == sorted(r.virtual_finish for r in got)
    assert {r._size for r in got} == {"mine"} and {r.target for r in got} == {"mine"}
    assert {r.copy for r in got} <= {0, 1, 2}


def test_odd_rows(spark, rng):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n", "en", "b", 0), (4, "one two", "en", "b", 0), (4, "one two", "en", "b", 0), (None, "x y z", "en", None, 0), (5, "w " * 40_000, "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_sizes(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got if r.doc_id) == [(False, 1, 0), (False, 2, 0), (False, 3, 0), (False, 4, 2), (False, 4, 2), (False, 5, 40000)]
    assert {r.taken for r in got if r.size == 0} == {0}
    assert mixing.mixed_sizes(docs.where("false")).count() == 0
    assert {r.taken for r in mixing.mixed_sizes(docs.where("doc_id < 4")).collect()} == {0}


def test_rows_of_one_id_queue_by_their_texts(spark, rng):
    rows = [(i, prose(rng, 6), "en", source, 0) for i in (7, None) for source in ("a", "b") for _ in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    orders = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        out = mixing.ordered(mixing.mix(spark.createDataFrame(rows, schema).repartition(3 + seed))[1], ["doc_id", "source", "text"])
        orders.append([tuple(r) for r in out.collect()])
    assert orders[0] == orders[1] and len(orders[0]) > 100
