import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, _part int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(d, text, lang, source, n):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)))


def plain_tree(leaves, arity):
    """Root, and for each leaf its siblings."""
    proofs, places, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, at in enumerate(places):
            run = level[at - at % arity : at - at % arity + arity]
            proofs[k] += run[: at % arity] + run[at % arity + 1 :]
        places = [at // arity for at in places]
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], proofs


def plain(rows, arity):
    out, trees = [], {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0], plain_leaf(*r)))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {}
    for t in names:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[t] = plain_tree([x[1] for x in trees[t]], arity)
    root, tops = plain_tree([made[t][0] for t in names], arity)
    for t, top in zip(names, tops, strict=True):
        out += [(d, h, made[t][0], root, "".join(p + top)) for (d, h), p in zip(trees[t], made[t][1], strict=True)]
    return out


def rows_of(rng, n):
    langs = ["en"] * 6 + ["de", "é", None, "", "z", "fr"]
    rows = [(i if rng.random() < 0.95 else None, rng.choice([None, "", "a b", "é" * 5, "x" * 2000]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 3])) for i in range(n)]
    return rows + rng.sample(rows, n // 10)


@pytest.mark.parametrize(("n", "arity", "per_part", "fan"), [(90, 2, 1000, 256), (150, 2, 12, 2), (120, 3, 9, 3), (1, 2, 5, 2), (7, 2, 1, 2)])
def test_same_as_whole_trees(spark, n, arity, per_part, fan):
    rows = rows_of(random.Random(n), n)
    df = spark.createDataFrame([(*r, "mine", "mine", 7) for r in rows], SCHEMA).repartition(3)
    tampered = F.col("doc_id") % 3 == 0
    claim = merkle.leaf([F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    got = merkle.manifest(df, claim, arity, per_part, fan).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=str) == sorted(plain(rows, arity), key=str)
    changed = {plain_leaf(*r) for r in rows if r[0] is not None and r[0] % 3 == 0 and r[4] is not None}
    for r in got:
        assert r.verified == (r.folded_root == r.root) == (r.leaf not in changed)


def test_merging_is_associative(rng):
    for arity, n in itertools.product((2, 3), (1, 2, 5, 16, 23)):
        values = [H(str(i)) for i in range(n)]
        cuts = sorted(rng.choices(range(n + 1), k=2))
        parts = [range(0, cuts[0]), range(cuts[0], cuts[1]), range(cuts[1], n)]
        made = []
        for part in parts:
            x = merkle.Fragment(n, arity)
            for i in part:
                x.add(0, i, values[i])
            made.append(x.resolve())
        a, b, c = made
        left, right = a.merge(b).merge(c), a.merge(b.merge(c))
        top = len(merkle.widths(n, arity)) - 1
        assert left.nodes == right.nodes == {top: {0: plain_tree(values, arity)[0]}}
        assert a.merge(merkle.Fragment(n, arity)).nodes == a.nodes == merkle.Fragment(n, arity).merge(a).nodes


def test_a_fragment_is_small():
    x = merkle.Fragment(100_000)
    for i in range(12_345, 70_001):
        x.add(0, i, H(str(i)))
    assert sum(map(len, x.resolve().nodes.values())) <= 2 * 17


def test_many_trees_and_one_large(spark):
    rows = [(i, f"t{i}", "en" if i % 2 else f"l{i}", "s", 1) for i in range(400)]
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA)
    got = merkle.manifest(df, per_part=16, fan=4).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got]) == sorted(plain(rows, 2)) and all(r.verified for r in got)


def test_empty_and_long(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    r = merkle.manifest(spark.createDataFrame([(1, "ab " * 400_000, "en", "s", 5, "", "", 0)], SCHEMA)).first()
    assert r.proof == "" and r.leaf == r.subroot == r.root == r.folded_root == plain_leaf(1, "ab " * 400_000, "en", "s", 5)
