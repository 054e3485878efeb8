import random

import numpy as np
import pyarrow as pa
from corpus_text import prose
from pyspark.sql import functions as F

from riskloom.llm import line_dedup as ld
from riskloom.llm._text import utf8
from riskloom.llm.queries import op2_line_dedup


def test_every_line_survives_once_and_copies_go(make, rng):
    a, b = prose(rng, 12), prose(rng, 15)
    got = {r.doc_id: r.text for r in ld.line_dedup(make({3: f"{a}\n{b}", 1: f"{b}\nOwn words here.\n{a}", 2: f"{a}\n\n{b}"})).collect()}
    assert got == {1: f"{b}\nOwn words here.\n{a}", 2: "", 3: ""}


def test_short_repeats_stay(make):
    texts = {1: "Yes.\nNo.", 2: "Yes.\nNo.", 3: "Yes."}
    assert {r.n_removed for r in ld.line_dedup(make(texts)).collect()} == {0}


def test_repeats_within_a_document(make, rng):
    a = prose(rng, 11)
    row = ld.line_dedup(make({1: f"{a}\nx\n{a}\ny"})).first()
    assert row.text == f"{a}\nx\ny" and (row.n_lines, row.n_removed, row.n_words_removed) == (4, 1, 11)


def test_odd_rows(make, rng):
    a = prose(rng, 12)
    pairs = [(1, None), (2, ""), (3, "\n\n"), (None, a), (4, a), (5, a), (5, a), (6, prose(rng, 30_000) + "\n" + a)]
    docs = make(pairs).withColumn("n_removed", F.lit("mine")).withColumn("_id", F.lit("mine"))
    got = ld.line_dedup(docs)
    assert got.count() == len(pairs) and got.columns.count("n_removed") == 1
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == ["\n\n"] and by[None] == [a] and by[4] == [""] and by[5] == ["", ""] and not by[6][0].endswith(a)
    assert {r._id for r in got.collect()} == {"mine"}
    assert ld.line_dedup(make({})).count() == 0


def all_earlier(texts, s):
    """Lines in a run of min_words words or more that has any earlier position."""
    lines = {d: [x for x in (t or "").split("\n") if x.split()] for d, t in texts.items()}
    gone = {d: set() for d in lines}
    for d, mine in lines.items():
        for e, other in lines.items():
            for i in range(len(mine)):
                for j in range(len(other)):
                    n = 0
                    while (e, j) < (d, i) and i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in mine[i : i + n]) >= s.min_words:
                        gone[d] |= set(range(i, i + n))
    return {d: "\n".join(x for i, x in enumerate(mine) if i not in gone[d]) for d, mine in lines.items()}


def test_against_all_earlier_positions(make):
    rng = random.Random(8)
    pool = [prose(rng, rng.choice((1, 2, 3, 6, 12)), 5) for _ in range(30)]
    texts = {}
    for d in range(50):
        parts = []
        while len(parts) < rng.randrange(1, 14):
            at = rng.randrange(len(pool))
            parts += pool[at : at + rng.randrange(1, 5)] if rng.random() < 0.8 else [prose(rng, rng.randrange(1, 15))]
        texts[d] = "\n".join(parts)
    for s in (ld.Settings(), ld.Settings(min_words=8), ld.Settings(short=0)):
        got = {r.doc_id: r.text for r in ld.line_dedup(make(texts), s).collect()}
        want = all_earlier(texts, s)
        assert got == want and sum(len(t) for t in texts.values()) > sum(len(t) for t in want.values()) + 1000


def test_registered_query_compares_all_runs(spark, tmp_path, rng):
    passage = [prose(rng, 6) for _ in range(9)]  # 54 words; each line stands alone in an earlier document, too
    own = [prose(rng, 7) for _ in range(10)]
    texts = {1: "\n".join(x for pair in zip(passage, own, strict=False) for x in pair), 2: "\n".join(passage), 3: "\n".join([own[9], *passage]), 4: "\n".join(["Yes indeed."] * 180)}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 0, 3: 9, 4: 179}


def test_every_run_holds_a_fingerprint(rng):
    texts = ["\n".join(prose(rng, rng.choice((1, 2, 3, 9, 14)), 3) for _ in range(rng.randrange(30))) for _ in range(20)]
    s = ld.Settings()
    h, row, words = ld.lines_of(*utf8(pa.array(texts)))
    _, lo, hi = ld.windows(h, row, words, s)
    at = ld.fingerprints(h, words, lo, hi, s)
    assert ((lo <= at) & (at <= hi)).all() and (row[lo] == row[hi]).all()
    chosen = set(at.tolist())
    assert len(chosen) < len(h)
    key = lambda i: (words[i] < s.short, h[i] >> np.uint64(1), -i)
    assert all(min(range(a, b + 1), key=key) == i for a, b, i in zip(lo, hi, at, strict=True))
    for i in range(len(h)):
        for j in range(i, len(h)):
            if row[i] == row[j] and words[i : j + 1].sum() >= s.min_words:
                assert chosen & set(range(i, j + 1))
                break


def test_a_very_common_line_and_six_short_lines(make, rng):
    """Each line of the passage has an earlier first position elsewhere; a common line has thousands of partners."""
    common, passage = prose(rng, 11), [prose(rng, 8) for _ in range(6)]
    texts = {i: f"{passage[i]}\n{prose(rng, 9)}" for i in range(6)}
    texts |= {10 + i: "\n".join([prose(rng, 7), *passage, prose(rng, 7)]) for i in range(3)}
    texts |= {100 + i: f"{prose(rng, 6)}\n{common}\n{prose(rng, 6)}" for i in range(2000)}
    got = {r.doc_id: r.n_removed for r in ld.line_dedup(make(texts)).collect()}
    assert [got[i] for i in range(6)] == [0] * 6 and [got[10 + i] for i in range(3)] == [0, 6, 6]
    assert got[100] == 0 and all(got[100 + i] == 1 for i in range(1, 2000))
