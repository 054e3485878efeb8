import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import suffix_dedup as sd


def brute_force(rows, length=50):
    """The contract by definition over (doc_id, text) rows: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each; no id is the smallest."""
    order = lambda d: -(1 << 63) if d is None else d
    least = {}
    for d, x in rows:
        data = (x or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            least[key] = min(least.get(key, order(d)), order(d))
    out = []
    for d, x in rows:
        data = (x or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < order(d):
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((d, len(data), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(make, texts, s=None, length=50):
    """Bytes removed, after comparing all rows with the definition."""
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digest(sd.suffix_dedup(make(texts), s)).collect()]
    want = brute_force([*texts.items()] if isinstance(texts, dict) else texts, length)
    assert Counter(got) == Counter(want)
    return sum(x[2] for x in want)


def corpus(rng, n=120):
    """Documents that share passages, with different text at their edges, near copies, periodic and non-ASCII text."""
    word = lambda: "".join(rng.choice(["an", "the", "ion", "é", "st", "er", "ü"]) for _ in range(rng.randrange(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randrange(8, 40)) for _ in range(12)]
    out = {}
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            parts.append(rng.choice([text(rng.randrange(20)), p, p[cut:], p[:-cut] if cut else p, "ab" * rng.randrange(60), rng.choice("xyz") * rng.randrange(90)]))
        out[d] = rng.choice([" ", ""]).join(parts)
    out[n] = out[3]
    out[n + 1] = out[3][:40] + "!" + out[3][41:]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(make, seed):
    assert check(make, corpus(random.Random(seed))) > 3000


def test_small_arrays_are_merged(make):
    texts = corpus(random.Random(7))
    assert check(make, texts, sd.Settings(array_bytes=400, block_bytes=2000, flush=50, held_bytes=1000)) > 3000


def test_other_lengths(make):
    check(make, corpus(random.Random(9), 60), sd.Settings(length=30, gram=12), 30)


def test_hot_passage(make):
    rng = random.Random(4)
    line = "the very common line that a third of all the documents hold in their middle"
    texts = {d: "".join(rng.choice("abc d") for _ in range(40)) + line + "".join(rng.choice("abc d") for _ in range(40)) for d in range(300)}
    assert check(make, texts) >= 299 * len(line)
    # the same with its contexts dealt over several tasks
    assert check(make, texts, sd.Settings(hot=20, block_bytes=4000)) >= 299 * len(line)
    assert check(make, corpus(rng), sd.Settings(hot=2, array_bytes=300)) > 0


def test_odd_rows(make):
    a, b = "x1y2z3" * 20, "q" * 49
    texts = {1: None, 2: "", 3: a, 4: a, 5: b, 6: b, 7: a[:50], 8: "\x00" * 60, 9: "\x00" * 70, 10: "pre " + a}
    check(make, texts)
    rows = sd.digest(sd.suffix_dedup(make([(3, a), (3, a), (4, a), (None, a), (3, "another text, of the same id, that is not shared with anyone else")]))).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in rows) == [(False, 0, 0), (True, 3, 0), (True, 3, 120), (True, 3, 120), (True, 4, 120)]
    assert sd.suffix_dedup(make({})).count() == 0


def test_very_long_text(make):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    check(make, {1: long, 2: long[1000:200_000] + "!" + long[:900]})


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    cases = [[b"banana"], [b"aaaaaaaaaaaaaaaaaaaa"], [b"", b""], [b"abababababab", b"abababab", b"abababababab"]]
    cases += [[bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 6))] for _ in range(100)]
    for blobs in cases:
        size = np.array([len(b) for b in blobs])
        text = np.frombuffer(b"\xff".join(blobs), np.uint8)
        starts = np.r_[0, np.cumsum(size + 1)[:-1]]
        ends = starts + size
        owner = np.searchsorted(starts, np.arange(len(text)), "right") - 1

        def suffix(i, text=text, ends=ends, owner=owner):
            return [*text[i : ends[owner[i]]].tolist(), 256 + int(owner[i])]

        order = sd.suffix_array(text, ends)
        assert order.tolist() == sorted(range(len(text)), key=suffix)
        got = sd.common_prefixes(text, order, starts, ends, 50)
        for k in range(1, len(text)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            if text[order[k]] != 255:
                assert got[k] == min(next(i for i in range(99) if a[i] != b[i]), 50)


def test_every_window_holds_an_anchor():
    s = sd.Settings()
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    off = np.array([0, 10, 1000, 1000, 1049, 1100, 3000])
    at, _ = sd.anchors(data, off, s)
    for a, b in zip(off, off[1:], strict=False):
        for i in range(a, b - s.length + 1):
            assert ((at >= i) & (at + s.gram <= i + s.length)).any()


def test_packing():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 1 << 31, 100).astype("u4"), rng.integers(-(1 << 62), 1 << 62, 100), rng.integers(0, 1 << 16, 100).astype("u2")]
    back = sd.unpack(sd.pack(columns), 100, ["u4", "i8", "u2"])
    assert all(np.array_equal(a, b) for a, b in zip(columns, back, strict=True))
    texts = [bytes(range(k)) for k in range(100)]
    rows = sd.packed_by(sd.TEXTS, np.arange(100) % 3, [np.arange(100), np.array([len(x) for x in texts])], texts)
    (number, _), found = sd.unpack_texts(rows, sd.TEXTS, ["i8", "i8"], 1)
    assert [r[1] for r in rows] == [0, 1, 2] and {k: x for k, x in zip(number.tolist(), found, strict=True)} == dict(enumerate(texts))


@pytest.mark.parametrize("ids", ["null", "one id", "few ids"])
def test_repeated_and_null_ids(make, ids):
    """Rows that share an id, or have none, keep what only they share, and all others lose what any of them holds."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(16) for _ in range(2500)]
    id_of = {"null": lambda i: None, "one id": lambda i: 7, "few ids": lambda i: i % 3}[ids]
    rows = [(id_of(i), f"{text(3)} {passages[i % 2500]} {text(3)}") for i in range(5000)]
    rows += [(10_000 + i, f"{text(4)} {p} {text(4)}") for i, p in enumerate(passages)]
    assert check(make, rows) > 2500 * 50
    assert check(make, rows[:600] + rows[5000:5600], sd.Settings(block_bytes=2000, flush=200, held_bytes=3000, hot=5)) > 600 * 50


def test_copies_in_one_task_are_compared_by_bytes():
    data = np.frombuffer(b"abcdefgh" * 3, np.uint8)
    begin, end, at = np.array([0, 8, 16, 0]), np.array([8, 16, 24, 7]), np.array([2, 10, 18, 2])
    same = np.ones(4, np.uint64)
    # equal hashes throughout, but the last context is shorter
    assert sd.copies(data, begin, end, at, same, same, np.array([1, 2, 1, 3])).tolist() == [False, True, False, False]
    other = data.copy()
    other[12] = 0
    assert not sd.copies(other, begin, end, at, same, same, np.array([1, 2, 1, 3])).any()
    assert not sd.copies(data[:0], begin[:0], end[:0], at[:0], same[:0], same[:0], at[:0]).any()


def contexts(texts, s):
    """Of all anchors of {doc_id: text}: bytes of all texts, begin, place and end of the contexts, doc_id, hash."""
    blobs = [t.encode() for t in texts.values()]
    data, off = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)])
    at, h = sd.anchors(data, off, s)
    row = np.searchsorted(off, at, "right") - 1
    return data, off, np.maximum(at - s.reach, off[row]), at, np.minimum(at + s.length, off[row + 1]), np.array([*texts])[row], h


@pytest.mark.parametrize("s", [sd.Settings(), sd.Settings(step=1), sd.Settings(length=30, gram=12, step=4)])
def test_arrays_get_each_shared_string_once(s):
    texts = corpus(random.Random(5))
    data, off, begin, at, end, doc, h = contexts(texts, s)
    least, most = sd.first_minima(data, begin, at, end, s)
    low, high = sd.shared(data, at, least, most, doc, s)
    holders, times, kept = {}, Counter(), Counter()
    for d, a, b in zip(texts, off, off[1:], strict=False):
        for i in range(a, b - s.length + 1):
            holders.setdefault(data[i : i + s.length].tobytes(), set()).add(d)
    for i, a, b, c, d in zip(at.tolist(), least.tolist(), most.tolist(), low.tolist(), high.tolist(), strict=True):
        times.update(i - k for k in range(a, b + 1))
        kept.update(i - k for k in range(c, d + 1))
    every = [i for a, b in zip(off, off[1:], strict=False) for i in range(a, b - s.length + 1)]
    assert times == Counter(every)
    assert {i for i in every if len(holders[data[i : i + s.length].tobytes()]) > 1} <= set(kept) and max(kept.values()) == 1


def test_contexts_that_share_too_little_are_not_sorted():
    """A common phrase shorter than a string, with other text around it: its anchors have many contexts, and no array is needed."""
    rng, s = random.Random(6), sd.Settings()
    odd = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(60))
    phrase = "a common phrase of some thirty bytes"
    data, _, begin, at, end, doc, h = contexts({d: odd() + phrase + odd() for d in range(200)}, s)
    assert (np.unique(h, return_counts=True)[1] > 100).any()
    low, high = sd.shared(data, at, *sd.first_minima(data, begin, at, end, s), doc, s)
    assert not (low <= high).any()
    # twenty bytes more make it a string
    data, _, begin, at, end, doc, h = contexts({d: odd() + phrase + " and some twenty more" + odd() for d in range(200)}, s)
    low, high = sd.shared(data, at, *sd.first_minima(data, begin, at, end, s), doc, s)
    assert (low <= high).sum() >= 200


def test_refinement_of_a_long_text():
    """Too many suffixes for three ranks in 64 bits."""
    rng = np.random.default_rng(8)
    text = rng.integers(97, 99, 2_700_000).astype(np.uint8)
    text[2_000_000:] = text[1_000_000:1_700_000]
    assert (len(text) + 1) ** 3 > 1 << 64
    order = sd.suffix_array(text, np.array([len(text)]))
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    raw = text.tobytes() + b"\xff"
    for i in rng.integers(0, len(text) - 1, 300).tolist():
        assert raw[order[i] :] < raw[order[i + 1] :]


def test_small_packed_rows_are_read_together(monkeypatch):
    """At a large size there are many packed rows of a few entries: columns are made once for all of them, not once a row."""
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 1 << 31, 3000).astype("u4"), rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(0, 9, 3000).astype("u2")]
    texts, key = [bytes([i % 251]) * m for i, m in enumerate(columns[2].tolist())], rng.integers(0, 1000, 3000)
    rows = sd.packed_by(sd.TEXTS, key, columns, texts)
    assert all(blob == sd.pack([c[key == k] for c in columns]) for _, k, _, blob, _ in rows[:50])
    calls, real = [], np.ascontiguousarray
    monkeypatch.setattr(np, "ascontiguousarray", lambda *a, **b: calls.append(1) or real(*a, **b))
    back, found = sd.unpack_texts(rows, sd.TEXTS, ["u4", "i8", "u2"], 2)
    assert len(calls) < 10
    order = np.argsort(key, kind="stable")
    assert all(np.array_equal(a, c[order]) for a, c in zip(back, columns, strict=True)) and found == [texts[i] for i in order]
