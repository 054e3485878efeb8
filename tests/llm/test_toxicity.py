import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from corpus_text import prose

from riskloom.llm import toxicity as tox

LABELS = "doc_id long, quality int, toxic int"


def row(text, learned=()):
    return dict(zip(tox.NAMES, tox.features(pa.array([text]), tox._plain_hashes(list(learned)) if learned else np.zeros(0, np.uint64))[0], strict=True))


@pytest.mark.parametrize("text", ["idiot", "an Idiot!", "1d10t", "i.d.i.o.t", "what i d i o t says", "IDIOOOT!!", "$tup1d", "loooser.", "IMBÉCILE", "(moron)"])
def test_insults_are_found_however_written(text):
    assert row(text)["insults"] > 0


@pytest.mark.parametrize("text", ["", "the idiom", "a b c d", "class 1010", "losers' club? no: los er", "x" * 300])
def test_others_are_not(text):
    assert row(text)["insults"] == 0


def test_each_feature():
    r = row("You are SUCH an idiot!! m0ron")
    assert r["insults"] == pytest.approx(200 / 6) and r["addressed_hits"] == pytest.approx(200 / 6) and r["second_person"] == pytest.approx(100 / 6)
    assert r["shouted"] == pytest.approx(100 / 6) and r["obfuscated"] == r["obfuscated_hits"] == pytest.approx(100 / 6) and r["repeated_marks"] > 0 and r["exclaimed"] > 0
    assert row("you " + "w " * 10 + "idiot")["addressed_hits"] == 0 and row("idiot a b c d you")["addressed_hits"] > 0
    assert row("vequalo blah Vequé", ["vequ"])["learned"] == pytest.approx(200 / 3) and row("veq", ["vequ"])["learned"] == 0


def test_rows_of_a_slice_do_not_touch(rng):
    texts = ["you", "idiot", "", None, "i", "d", "i", "o", "t", "A!!", "!! b"] + [prose(rng, 30) for _ in range(5)]
    together = tox.features(pa.array(texts), np.zeros(0, np.uint64))
    alone = np.concatenate([tox.features(pa.array([t], pa.string()), np.zeros(0, np.uint64)) for t in texts])
    assert np.allclose(together, alone)


def test_pieces_add_up(rng):
    text = prose(rng, 3000) + " é" + "x" * 5000 + " you idiot. " + prose(rng, 50)
    whole = tox.features(pa.array([text]), np.zeros(0, np.uint64))
    cut = tox.features(pa.array([text]), np.zeros(0, np.uint64), limit=1000)
    same = [i for i, n in enumerate(tox.NAMES) if n not in ("punctuation", "log_words", "second_person", "learned")]
    assert b"".join(x.tobytes() for x in tox._pieces(np.frombuffer(text.encode(), np.uint8), 1000)) == text.encode()
    assert np.allclose(whole[:, same], cut[:, same], rtol=0.02)


def test_isotonic_is_the_closest_increasing_function(rng):
    for _ in range(40):
        n = rng.randrange(1, 30)
        m = np.array([rng.randrange(12) for _ in range(n)], float)
        y = np.array([rng.randrange(2) for _ in range(n)], float)
        got = np.interp(m, *tox.isotonic(m, y))
        # min-max formula of isotonic regression
        at = np.unique(m)
        mean = lambda a, b: y[(m >= a) & (m <= b)].mean()  # noqa: E731, B023
        want = {x: max(min(mean(a, b) for b in at if b >= x) for a in at if a <= x) for x in at}
        assert np.allclose(got, [want[x] for x in m])


def test_trees_learn_and_walk_alike(rng):
    x = np.array([[rng.random(), rng.choice([0, 0, 0, rng.random()]), rng.random()] for _ in range(600)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.2)).astype(float)
    model = tox.boosted(x, y, tox.Settings())
    p = 1 / (1 + np.exp(-tox.margins(x, model)))
    assert ((p > 0.5) == y).mean() > 0.98 and len(model[0]) == tox.Settings().rounds
    tiny = tox.boosted(np.ones((4, 3)), np.array([0, 1, 0, 1.0]), tox.Settings())
    assert np.allclose(tox.margins(np.ones((4, 3)), tiny), tiny[1])


def corpus(rng, n):
    """Texts of which the toxic ones hold insults, or words of a stem that only labels tell."""
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 80)).split()
        y = int(rng.random() < 0.25)
        for _ in range(rng.randrange(1, 4) * y):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "m0ron!", "scum###"]) if i % 2 else f"grunz{rng.choice('abcdefgh')}{rng.randrange(9)}")
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, 1, y))
    return docs, labels


def test_held_out_accuracy(spark, make):
    docs, labels = corpus(random.Random(3), 1500)
    got = {r.doc_id: r for r in tox.toxicity(make(docs), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(docs) and all(got[d].held_out == (crc32(str(d).encode()) % 5 == 0) for d in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[d].predicted, y) for d, _, y in labels if got[d].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    learned, _ = tox.train(make(docs), spark.createDataFrame(labels, LABELS))
    assert set(tox._plain_hashes(["grunz"])) <= set(learned) and not set(tox._plain_hashes(["alpha", "omega"])) & set(learned)


def test_held_out_labels_are_never_read(spark, make):
    docs, labels = corpus(random.Random(5), 300)
    turned = [(d, q, 1 - y if crc32(str(d).encode()) % 5 == 0 else y) for d, q, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in tox.toxicity(make(docs), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert a == b


def test_a_passage_of_copies_is_not_learned(spark, make):
    rng = random.Random(7)
    docs = [(i, prose(rng, 40) + (" kept word zzqqxx here" if i < 60 else "")) for i in range(300)]
    labels = [(i, 1, int(i < 60)) for i in range(300)]
    learned, _ = tox.train(make(docs), spark.createDataFrame(labels, LABELS))
    assert not set(tox._plain_hashes(["zzqqxx"])) & set(learned)


def test_odd_tables(spark, make):
    none, labels = spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (3, 0, 0), (None, 1, 1)], LABELS)
    docs = make([(1, "you idiot"), (1, "fine words"), (2, None), (3, ""), (None, "nothing"), (4, "long " * 300_000)])
    for given in (none, labels):
        got = tox.toxicity(docs, given).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert all(r.score == 0 for r in tox.toxicity(docs, none).collect())
    assert tox.toxicity(make([]), labels).count() == 0
