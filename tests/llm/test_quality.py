import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from corpus_text import prose
from pyspark.sql import functions as F

from riskloom.llm import quality_classifier as qc
from riskloom.llm import quality_rules as qr

SPACES = "\x20\t\n\x0b\x0c\r"


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_rules(make):
    rng = random.Random(2)
    parts = ["a", "b", "c ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "#", "<|>", "é", "😀 ", "one two three ", "\r\n"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(200))) for i in range(400)} | {1000: None, 1001: "", 1002: "x" * 200_000}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.quality_rules(make(texts)).collect()}
    assert got == {i: brute_rules(t) for i, t in texts.items()}


def test_bands(make, rng):
    noise = "".join(chr(33 + rng.randrange(90)) + (" " if rng.random() < 0.1 else "") for _ in range(6000))
    varied = "\n".join(f"line {i % 7} of {i % 11} the same old story {i % 13}" for i in range(400))
    texts = {1: prose(rng, 400, 30), 2: noise, 3: varied, 4: prose(rng, 30)}
    got = {r.doc_id: (r.kept, r.reason) for r in qr.quality_rules(make(texts), qr.Bands(whole=((0, 0.0, 5.0), (200, 1.3, 4.0)))).collect()}
    assert got[1] == (True, None) and got[2] == (False, "incompressible") and got[3][1] in ("repetitive", "base") and got[4] == (False, "base")
    half = prose(rng, 1500, 5000) + " " + "z" * 20_000
    assert not {r.doc_id: r.kept for r in qr.quality_rules(make({1: half})).collect()}[1]


def test_rules_on_odd_rows(make):
    assert qr.quality_rules(make({})).count() == 0
    assert qr.quality_rules(make([(None, "a"), (1, "a"), (1, "a")])).count() == 3


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_classifier_on_held_out_rows(spark, make):
    rng = random.Random(4)
    texts, label = {}, {}
    for i in range(500):
        good = i % 3 > 0
        words = prose(rng, rng.randrange(5, 60), 30).split()
        texts[i] = " ".join(words if good else [w.upper() + "!!" for w in words])
        label[i] = int(good)
    rows = [(i, y, None) for i, y in label.items()] + [(1, None, None), (1, label[1], None), (9999, 1, None), (None, 1, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    docs = make([*texts.items(), (7000, None), (7001, ""), (None, "null id"), (0, texts[0])])
    got = qc.quality_classifier(docs, labels).collect()
    assert len(got) == 504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    mine = [r for r in got if r.doc_id is not None and r.doc_id < 500]
    assert all(r.held_out == held(r.doc_id) for r in mine)
    right = [r.predicted == label[r.doc_id] for r in mine if r.held_out]
    assert len(right) > 60 and np.mean(right) > 0.97
    again = qc.quality_classifier(docs, labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_classifier_ignores_held_out_labels(spark, make, rng):
    texts = {i: prose(rng, 20) for i in range(100)}
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 0).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in qc.quality_classifier(make(texts), x).collect()) for x in (labels, flipped))
    assert a == b


def test_classifier_without_labels_or_rows(spark, make, rng):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.quality_classifier(make({1: prose(rng, 9)}), none).collect()} == {0.5}
    assert qc.quality_classifier(make({}), none).count() == 0


def test_kept_columns_that_clash(make):
    docs = make({1: "some text"}).withColumn("held_out", F.lit("mine")).withColumn("predicted", F.lit("mine"))
    out = qc.score(docs, (np.zeros(1 << 18), 0.0), keep=tuple(docs.columns))
    assert sorted(out.columns) == sorted([*docs.columns]) and out.first().score == 0.5


def test_features_of_stuttering_text_are_shared():
    s = qc.Settings()
    at = [set(qc.features(np.frombuffer(x, np.uint8), np.array([0, len(x)]), s)[0].tolist()) for x in (b"foo foo foo foo", b"bar bar bar bar")]
    assert len(at[0] & at[1]) >= 2


def test_chunks_see_the_whole_text(make):
    rng = random.Random(12)
    compress = __import__("zstandard").ZstdCompressor(level=3).compress
    clean = prose(rng, 4000, 5000)
    junk = "".join(chr(33 + rng.randrange(94)) + (" " if rng.random() < 0.1 else "") for _ in range(4090))[:4090]
    texts = {1: clean[:8192] + junk, 2: clean[:4000] + junk[:4000], 3: clean[:8192], 4: clean[:6000], 5: clean[:4096], 6: clean[:4097]}
    assert all(len(t) / len(compress(t.encode())) > 1.3 for t in texts.values())
    got = {r.doc_id: r for r in qr.quality_rules(make(texts)).collect()}
    assert {d: r.n_chunks for d, r in got.items()} == {1: 3, 2: 2, 3: 2, 4: 2, 5: 0, 6: 2}
    assert got[1].reason == got[2].reason == "chunks" and (got[1].bad_chunks, got[2].bad_chunks) == (1, 1)
    assert all(got[d].kept for d in (3, 4, 5, 6))


def test_weights_are_those_of_plain_ftrl():
    """The updates of FTRL-proximal, coordinate by coordinate, over dictionaries; and scores as plain dot products."""
    rng = random.Random(7)
    s = qc.Settings(bits=10, epochs=2)
    texts = [" ".join(rng.choice(("one", "two", "two", "three,", "FOUR!")) for _ in range(rng.randrange(1, 15))) for _ in range(80)]
    labels = [int("FOUR" not in t) for t in texts]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    counts = [Counter(qc.features(r, np.array([0, len(r)]), s)[0].tolist()) for r in raw]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    def value(c):
        return {-1: 1.0} | {i: k * s.scale / sum(c.values()) for i, k in c.items()}

    for _ in range(s.epochs):
        for c, y in zip(counts, labels, strict=True):
            x = value(c)
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v * (1 if y else s.zero_weight)
                w, more = weight(i), (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i] += g - more * w
                n[i] += g * g
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(80)), "_y": labels, "text": texts})
    blobs = [b.as_py() for out in qc.packed(iter([batch]), s) for b in out.column("features")]
    w, bias = qc.ftrl(list(zip(blobs, labels, strict=True)), s)
    assert np.allclose(w, [weight(i) for i in range(1 << s.bits)]) and math.isclose(bias, weight(-1))
    assert np.count_nonzero(w) > 20


def test_scores_are_plain_dot_products(make, rng):
    s = qc.Settings(bits=10)
    w, bias = np.random.default_rng(3).normal(size=1 << 10), 0.25
    texts = {i: prose(rng, rng.randrange(40)) for i in range(50)} | {50: None, 51: prose(rng, 30_000)}
    for r in qc.score(make(texts), (w, bias), s).collect():
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        c = Counter(qc.features(data, np.array([0, len(data)]), s)[0].tolist())
        total = bias + sum(w[i] * k * s.scale / sum(c.values()) for i, k in c.items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9) and r.predicted == (r.score >= 0.3)


def test_bands_against_the_rule(make):
    """Verdict, ratios and chunks, recomputed text by text from the limits."""
    import zstandard

    rng, bands = random.Random(21), qr.Bands()
    compress = zstandard.ZstdCompressor(level=3).compress
    pieces = [lambda: prose(rng, 300, 5000), lambda: "".join(chr(33 + rng.randrange(94)) for _ in range(900)) + " ", lambda: "same old words " * 90, lambda: prose(rng, 60, 9) + "\n", lambda: "é ü 漢字 " * 20]
    texts = {i: " ".join(rng.choice(pieces)() for _ in range(rng.randrange(12))) for i in range(150)} | {999: None, 1000: prose(rng, 40_000)}
    for r in qr.quality_rules(make(texts)).collect():
        data = (texts[r.doc_id] or "").encode()
        ratio = len(data) / len(compress(data)) if data else 0.0
        low, high = [(a, b) for begin, a, b in bands.whole if len(data) >= begin][-1]
        cuts = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
        if cuts:
            cuts[-1] = data[-4096:]
        bad = sum(not 1.3 <= len(c) / len(compress(c)) <= 2.8 for c in cuts)
        kept = not brute_rules(texts[r.doc_id])[-1] and low <= ratio <= high and not (cuts and bad > 0.2 * len(cuts))
        assert (r.whole_ratio, r.n_chunks, r.bad_chunks, r.kept) == (ratio, len(cuts), bad, kept)
