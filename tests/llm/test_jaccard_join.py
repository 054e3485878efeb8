import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_text import prose

from riskloom.llm import jaccard_join as jj


def brute(pairs, limit=0.8):
    """(class, links) of every document by comparing all sets."""
    texts = dict(pairs)

    def shingles(x):
        w = (x or "").encode().split()
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets, at = {d: shingles(t) for d, t in texts.items()}, defaultdict(list)
    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    links, parent = Counter(), {d: d for d in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        both = Counter(e for g in s for e in at[g] if e != d)
        for e, n in both.items():
            if n / (len(s) + len(sets[e]) - n) >= limit:
                links[d] += 1
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
    return {d: (top(d), links[d]) for d in texts}


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = prose(rng, rng.randrange(6, 150))
        texts += [base] * rng.randrange(1, 4) + [near(rng, base, rng.randrange(1, 5)) for _ in range(rng.randrange(4))]
    hot = prose(rng, 120)
    texts += [near(rng, hot, rng.randrange(3)) for _ in range(150)] + [hot] * 40
    line = prose(rng, 14)
    texts += [prose(rng, rng.randrange(5, 60)) + " " + line for _ in range(100)] + [prose(rng, 3)] * 3 + ["one two three four", "one two three"]
    rng.shuffle(texts)
    return dict(enumerate(texts)) | {5000: None, 5001: "", 5002: " \n"}


@pytest.mark.parametrize("block", [512, 16])
def test_links_and_classes(make, corpus, block):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(make(corpus), jj.Settings(block=block)).collect()}
    want = brute(corpus.items())
    assert got == want and sum(n for _, n in want.values()) > 5000


def test_recall_at_the_threshold(make):
    rng = random.Random(5)
    texts = {}
    for i in range(300):  # pairs of 44 shingles of which 5 differ: 39 / 49 is just below, 40 / 48 above
        base = prose(rng, 48)
        texts[2 * i], texts[2 * i + 1] = base, " ".join([*base.split()[:44], "other", *base.split()[45:]])
    got = {r.doc_id: r.n_links for r in jj.jaccard_join(make(texts)).collect()}
    want = {d: n for d, (_, n) in brute(texts.items()).items()}
    assert sum(want.values()) == 600 and sum(got[d] for d in want) >= 0.99 * 600 and all(got[d] <= want[d] for d in want)


def test_other_thresholds(make, corpus):
    s = jj.Settings(threshold=0.6)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(make(corpus), s).collect()}
    assert got == brute(corpus.items(), 0.6)


def test_odd_rows(make, rng):
    a = prose(rng, 20)
    rows = [(1, a), (1, a), (2, a), (None, a), (3, None), (4, ""), (7, prose(rng, 40_000)), (8, "x"), (9, "x"), (10, a), (10, prose(rng, 9))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(make(rows)).collect()}
    assert got[1][0] == 1 and got[2][0] == 1 and got[None] == (None, 0) and got[3] == (3, 0) and got[4] == (4, 0) and got[7] == (7, 0) and got[9] == (8, 1)
    assert got[1][1] in (1, 2) and len(got) == 9
    assert jj.jaccard_join(make({})).count() == 0


def by_rows(rows):
    """Links and classes of ids, and the rows that stay, from all pairs of different (doc_id, text)."""
    import hashlib

    texts = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    found = brute(enumerate(t for _, t in texts))
    links, parent = Counter(), {d: d for d, _ in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(texts):
        links[d] += found[i][1]
        a, b = top(d), top(texts[found[i][0]][0])
        parent[max(a, b)] = min(a, b)
    kept = {r for i, r in enumerate(texts) if found[i][0] == i}
    return {d: (top(d), links[d]) for d, _ in texts}, Counter((d, t) for d, t in rows if d is None or (d, t or "") in kept)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_ids_lose_neither_links_nor_texts(make, seed):
    """Ids with several texts, in both orders of their hashes, null ids, empty texts, equal rows."""
    rng = random.Random(seed)
    bases = [prose(rng, rng.randrange(8, 60)) for _ in range(12)]
    pool = bases + [near(rng, b, 1) for b in bases] + ["", None, "one two"]
    rows = [(rng.choice([None, *range(25)]), rng.choice(pool)) for _ in range(70)]
    if seed == 0:
        rows = [(1, bases[1]), (5, bases[0]), (5, bases[1]), (6, bases[1]), (7, bases[0])]
    if seed == 1:
        rows = [(1, bases[0]), (5, bases[0]), (5, bases[1]), (6, bases[1]), (7, bases[0])]
    want, kept = by_rows(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(make(rows)).collect() if r.doc_id is not None}
    assert got == want
    assert Counter((r.doc_id, r.text) for r in jj.one_of_each(make(rows)).collect()) == kept


def test_common_counts():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(25)]
    off = np.r_[0, np.cumsum([len(x) for x in lists])]
    got = jj.common(np.concatenate(lists), off, 25)
    assert (got == [[len(set(a) & set(b)) if len(a) and len(b) else 0 for b in lists] for a in lists]).all() or np.array_equal(got - np.diag(np.diag(got)), np.array([[len(set(a) & set(b)) for b in lists] for a in lists]) * (1 - np.eye(25)))


def pairs_compared(docs, s):
    """Pairs that the buckets of the operator hold, its result, and how many buckets are larger than a block."""
    seen = []
    kept = jj.split_large

    def spy(inside, sets_of, settings):
        out = kept(inside, sets_of, settings)
        seen.append([r["n"] for r in out.groupBy("bucket").count().withColumnRenamed("count", "n").collect()])
        return out

    jj.split_large = spy
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(docs, s).collect()}
    finally:
        jj.split_large = kept
    return sum(n * n for n in seen[0]), got, sum(n > s.block for n in seen[0])


def test_documents_that_share_a_passage_part_again(make):
    """Passages of 35 words in 200 documents each: nodes of their tokens are split until few pairs are left."""
    rng = random.Random(15)
    passages = [prose(rng, 35) for _ in range(8)]
    texts = [f"{prose(rng, 85, 5000)} {passages[i % 8]}" for i in range(1600)]
    texts += [near(rng, texts[i], 1) for i in range(60)]
    corpus = dict(enumerate(texts))
    want = brute(corpus.items())
    flat, got, large = pairs_compared(make(corpus), jj.Settings(block=32, more=0))
    assert got == want and large > 0
    split, got, large = pairs_compared(make(corpus), jj.Settings(block=32, more=8))
    assert got == want and split * 3 < flat
    assert sum(n for _, n in want.values()) > 80


def test_sets_that_are_alike_are_not_split(make):
    rng = random.Random(16)
    base = prose(rng, 200)
    corpus = {i: near(rng, base, 1) for i in range(200)}
    _, got, large = pairs_compared(make(corpus), jj.Settings(block=32, more=8))
    assert got == brute(corpus.items()) and large > 0
