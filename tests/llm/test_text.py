import random
import re

import numpy as np
import pyarrow as pa

from riskloom.llm import _text as t


def column(texts):
    return pa.array(texts, pa.string())


def test_words_equal_the_pattern():
    rng = random.Random(1)
    texts = [None, "", " ", "a", *("".join(rng.choice("ab \t\n\x0b\x0c\ré  😀") for _ in range(40)) for _ in range(200))]
    data, off = t.utf8(column(texts))
    starts, ends, row = t.runs(t.IS_WORD[data], off)
    got = [[] for _ in texts]
    for a, b, r in zip(starts, ends, row, strict=True):
        got[r].append(bytes(data[a:b]).decode())
    assert got == [re.findall(t.WORD, x or "") for x in texts]


def test_hashes_depend_on_content_only():
    data, off = t.utf8(column(["one two one", "two", "x" * 5000 + " one"]))
    h, row = t.word_hashes(data, off)
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3 and row.tolist() == [0, 0, 0, 1, 2, 2]


def test_shingle_sets():
    texts = ["a b c d e f", "a b", "", None, "a b c d e", "a b c d e a b c d e"]
    g, off = t.shingle_sets(*t.utf8(column(texts)))
    sets = [set(g[a:b].tolist()) for a, b in zip(off, off[1:], strict=False)]
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 5]
    assert sets[4] < sets[0] and not sets[1] & sets[0]


def test_slices_cover_everything_once():
    texts = [None, "x" * 50, "", "y" * 200, "z", None]
    batch = pa.RecordBatch.from_arrays([column(texts)], names=["text"])
    parts = list(t.slices(batch.slice(1), "text", 64))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts[1:]
    assert max(p.num_rows for p in parts) > 1


def test_sliced_columns():
    data, off = t.utf8(column(["aa", "bb", "cc"]).slice(1, 1))
    assert bytes(data) == b"bb" and off.tolist() == [0, 2]
    assert np.array_equal(t.utf8(column([]))[1], [0])
