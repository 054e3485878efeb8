import random
from collections import Counter

import numpy as np
import pyarrow as pa
from corpus_text import prose

from riskloom.llm import decontaminate as d

ITEMS = "item_id long, text string, answer string"


def found(docs, items, s=None):
    return sorted((r.doc_id, x.item_id, round(x.similarity, 6), x.start_word, x.end_word) for r in d.find_leaks(docs, items, s).collect() for x in r.leaks)


def brute(texts, items, k=5, limit=0.8):
    """Every item-sized window by definition."""
    import re

    norm = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    shingle = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
    out = []
    for doc, text in texts.items():
        words = norm(text)
        for item, passage in items.items():
            want = Counter(shingle(norm(passage)))
            if not want:
                continue
            g = shingle(words)
            span = min(sum(want.values()), len(g))
            best = 0.0
            for i in range(len(g) - span + 1 if g else 0):
                have = Counter(g[i : i + span])
                best = max(best, sum((have & want).values()) / sum((have | want).values()))
            if best >= limit:
                out.append((doc, item, round(best, 6)))
    return sorted(out)


def test_against_every_window(spark, make):
    rng = random.Random(3)
    items = {i: prose(rng, n) for i, n in enumerate((6, 20, 20, 31, 60, 3))}
    edited = items[3].split()
    edited[15] = "other"
    texts = {
        1: prose(rng, 80) + " " + items[1].upper() + ". " + prose(rng, 40), 2: items[0], 3: " ".join(edited), 4: prose(rng, 200), 5: None, 6: "",
        7: items[5], 8: "x " + items[5], 9: prose(rng, 10) + " " + " ".join(items[4].split()[:50]) + " " + prose(rng, 30), 10: items[2] + "\n" + items[2] + " " + items[0],
        11: " ".join(items[1].split()[:12]), 12: " ".join(items[4].split()[2:]),
    }
    docs = make(texts)
    bench = spark.createDataFrame([*((i, t, "a") for i, t in items.items()), (98, None, "a"), (99, "", "a")], ITEMS)
    want = brute(texts, items)
    assert [x[:3] for x in found(docs, bench)] == want and len(want) == 6
    # items in several blocks give the same
    assert [x[:3] for x in found(docs, bench, d.Settings(block_items=2))] == want


def flipped(rng, prints, most):
    """Copies of fingerprints with up to ``most`` bits changed, and how many."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(bits.shape[1], rng.integers(0, most + 1), replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint16)


def distance(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    for blocks in (4, 32, 96):
        prints, group = rng.integers(0, 1 << 16, (150, blocks)).astype(np.uint16), rng.integers(1, 4, 150)
        base = rng.integers(0, 150, 300)
        queries = flipped(rng, prints[base], 2 * blocks)
        q, p = d.HammingIndex(prints, group).near(queries, group[base])
        got = set(zip(q.tolist(), p.tolist(), strict=True))
        within = {(i, j) for i in range(300) for j in range(150) if group[base[i]] == group[j] and distance(queries[i], prints[j]) < blocks}
        agree = {(i, j) for i in range(300) for j in range(150) if group[base[i]] == group[j] and (queries[i] == prints[j]).any()}
        assert within <= got == agree and len(within) > 80


def test_index_prunes_and_finds_similar_windows():
    """20,000 items: under 1 % of all pairs are candidates, and of windows at similarity 0.8 more than 99 % are found."""
    rng = np.random.default_rng(5)
    s, n, m = d.Settings(), 20_000, 45
    items = rng.integers(0, 1 << 63, (n, m), dtype=np.uint64)
    windows = items[:1500].copy()
    for w in windows:
        w[rng.choice(m, 5, replace=False)] = rng.integers(0, 1 << 63, 5, dtype=np.uint64)  # 40 of 50 shingles: exactly 0.8
    ends = (np.arange(n) + 1) * m
    prints = np.concatenate([x for _, x in d.simhash(items.ravel(), ends - m, ends, s)])
    queries = np.concatenate([x for _, x in d.simhash(windows.ravel(), ends[:1500] - m, ends[:1500], s)])
    q, p = d.HammingIndex(prints, np.full(n, m)).near(queries, np.full(1500, m))
    assert len(q) < 0.01 * 1500 * n
    assert np.sum(q == p) > 0.99 * 1500


def test_simhash_of_overlapping_windows():
    rng = np.random.default_rng(6)
    g = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for span, group in ((5, 2048), (40, 64), (300, 64), (899, 64)):
        s = d.Settings(blocks=8, group=group)
        starts = np.flatnonzero(rng.random(900 - span + 1) < 0.5)
        got = np.concatenate([np.zeros((0, 8), np.uint16), *(x for _, x in d.simhash(g, starts, starts + span, s))])
        want = [np.packbits(d.signs(g[a : a + span], 8).sum(axis=0, dtype=int) > 0).view(np.uint16) for a in starts]
        assert len(got) == len(starts) and all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))


def test_memory_is_bounded():
    """A text of 100 MB that holds items everywhere: beyond its shingles (8 bytes each), little is allocated at once."""
    import tracemalloc

    rng = random.Random(9)
    items = [prose(rng, 40) for _ in range(50)]
    index = d.ItemIndex(list(range(50)), items, d.Settings())
    g, off, words = d.shingles(pa.array([" ".join(items[i % 50] for i in range(100))]), 5)
    n = 12_000_000  # shingles of a text of about 100 MB, nearly all of them no item's
    long = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    long[5_000_000 : 5_000_000 + len(g)] = g
    hit = index.hits(long)
    tracemalloc.start()
    found = index.leaks(long, hit, n + 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {x["item_id"] for x in found} == set(range(50)) and peak < 40 * n


def test_no_items_no_documents_and_clashing_columns(spark, make, rng):
    text = prose(rng, 30)
    bench = spark.createDataFrame([(1, text, "a")], ITEMS)
    assert found(make({1: text}), bench.where("false")) == []
    assert found(make({}), bench) == []
    from pyspark.sql import functions as F

    odd = make([(1, text), (1, text), (None, text)]).withColumn("leaks", F.lit("mine")).withColumn("_text", F.lit("mine")).withColumn("_new", F.lit(1))
    got = d.find_leaks(odd, bench)
    assert [r.leaks[0].item_id for r in got.collect()] == [1, 1, 1] and got.columns.count("leaks") == 1
    assert {r._text for r in got.collect()} == {"mine"}


def test_very_long_text(make, spark, rng):
    item = prose(rng, 40)
    long = prose(rng, 60_000, 5000)
    bench = spark.createDataFrame([(1, item, "a")], ITEMS)
    assert [x[:2] for x in found(make({1: long + " " + item, 2: long}), bench)] == [(1, 1)]
