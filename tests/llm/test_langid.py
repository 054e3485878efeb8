import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import langid

PARTS = {"aa": ["ka", "to", "mi", "ru", "sen"], "bb": ["sch", "ung", "ein", "keit", "ver"], "cc": ["oui", "eau", "tion", "ère", "que"]}


def write(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, write(rng, lang, rng.randrange(3, 60)).upper() if i % 10 == 0 else write(rng, lang, rng.randrange(3, 60)), lang, "s") for i in range(600) for lang in [rng.choice(list(PARTS))]]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !!", "aa", "s"), (1003, write(rng, "bb", 9), None, "s"), (None, write(rng, "aa", 9), "aa", "s")]
    rows += [(2000, write(rng, "aa", 70) + " " + write(rng, "bb", 30), None, "s"), (2001, write(rng, "cc", 50_000), None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("mine")).cache()


@pytest.fixture(scope="module")
def model(docs):
    return langid.learn(docs)


def test_held_out_accuracy(docs, model):
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 600").collect()}
    out = [got[i].lang_pred == lang for i, lang in truth.items() if got[i].held_out]
    assert len(out) > 80 and np.mean(out) > 0.97
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and got[None].lang_pred == "aa" and got[2001].lang_pred == "cc"


def test_mixture(docs, model):
    row = langid.predict(docs.where("doc_id = 2000"), model).first()
    share = dict(x.split(":") for x in row.mixture.split(","))
    assert set(share) == {"aa", "bb"} and 0.5 < float(share["aa"]) < 0.8 and row.lang_pred == "aa"


def test_one_language_is_not_split(docs, model):
    rows = langid.predict(docs.where("doc_id < 600"), model).collect()
    assert np.mean([r.score for r in rows]) > 0.95 and np.mean([r.score == 1 for r in rows]) > 0.7


def test_learns_only_outside_the_fold(docs, model):
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("zz")).otherwise(F.col("lang")))
    langs, table = langid.learn(other)
    assert langs == ["aa", "bb", "cc"] and np.allclose(table, model[1])


def test_the_bound_holds(docs):
    langs, _ = langid.learn(docs, langid.Settings(per_lang=3))
    assert langs == ["aa", "bb", "cc"]


def test_empty_tables(docs):
    none = docs.where("false")
    assert langid.language_id(none).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.limit(5), langid.learn(none)).collect()} == {"und"}


def plain_mixture(like, count, s):
    """Expectation and maximisation n-gram by n-gram, for the best set of languages by penalised likelihood, added one by one."""
    langs, grams = range(len(like)), range(len(count))
    weight = [c * s.independent for c in count]
    price = s.penalty * math.log(max(2.0, sum(weight)))
    p = [[math.exp(like[j][g] - max(like[x][g] for x in langs)) for g in grams] for j in langs]

    def fit(chosen):
        share = {j: 1 / len(chosen) for j in chosen}
        for _ in range(s.rounds if len(chosen) > 1 else 1):
            got = dict.fromkeys(chosen, 0.0)
            for g in grams:
                total = sum(share[j] * p[j][g] for j in chosen)
                for j in chosen:  # the part of this n-gram that language j answers for
                    got[j] += weight[g] * share[j] * p[j][g] / total
            share = {j: x / sum(weight) for j, x in got.items()}
        return sum(weight[g] * math.log(sum(share[j] * p[j][g] for j in chosen)) for g in grams), share

    first = max(langs, key=lambda j: (sum(like[j][g] * weight[g] for g in grams), -j))
    chosen, (best, share) = [first], fit([first])
    while len(chosen) < len(like):
        (value, found), new = max(((fit([*chosen, j]), j) for j in langs if j not in chosen), key=lambda x: (x[0][0], -x[1]))
        if value - best <= price:
            break
        chosen, best, share = [*chosen, new], value, found
    return [share.get(j, 0.0) for j in langs]


def test_mixture_against_plain_em(model):
    rng, s, sets = random.Random(8), langid.Settings(), set()
    for _ in range(60):
        text = " ".join(write(rng, rng.choice(list(PARTS)[: rng.randrange(1, 4)]), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4)))
        v = langid.grams(text, s.bits)
        at = np.flatnonzero(v)
        like = model[1][:, at].astype(np.float64)
        want = plain_mixture(like.tolist(), v[at].tolist(), s)
        assert np.allclose(langid.mixture(like, v[at].astype(np.float64), s), want, atol=1e-9)
        sets.add(sum(x > 0 for x in want))
    assert sets >= {1, 2}


def test_ties_and_repeated_rows(spark, docs, model):
    _, table = model
    row = docs.where("doc_id = 1003").drop("score")
    twice = row.unionByName(row).unionByName(row.withColumn("doc_id", F.lit(None).cast("long")))
    got = langid.predict(twice, (["x", "y"], np.stack([table[1], table[1]]))).collect()
    assert [r.lang_pred for r in got] == ["x"] * 3 and [r.score for r in got] == pytest.approx([1.0] * 3)
