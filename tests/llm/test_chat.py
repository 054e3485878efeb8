import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def formatted(spark, rows, **k):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    out = chat.format_chat(df, **k)
    return {
        r.conv_id: r
        for r in out.select("conv_id", "valid", "segments", chat.formatted(F.col("segments")).alias("out"), chat.loss_text(F.col("segments")).alias("loss"))
        .withColumn("back", chat.parse(F.col("out"))).collect()
    }


def test_exact_output_and_flags(spark):
    r = formatted(spark, [(1, 1, "assistant", "Hi"), (1, 0, "user", "Hello")])[1]
    assert r.out == "<|im_start|>user\nHello<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
    assert [s.text for s in r.segments if s.loss] == ["Hi"] and r.loss == "Hi" and r.valid


def test_random_texts_come_back(spark):
    rng = random.Random(8)
    pieces = ["<|im_end|>", "<|im_start|>", "<|", "<", "|", "\\", "\\\\", "\n", "assistant", "<\\|", "é", "😀", "", " "]
    make = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randrange(n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", make(4)]), make(12)) for c in range(60) for t in range(rng.randrange(1, 9))]
    got = formatted(spark, rows)
    for c, r in got.items():
        mine = [x for x in rows if x[0] == c]
        assert [(b.role, b.text) for b in r.back] == [(x[2], x[3]) for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.out


def test_machine_over_blocks(spark):
    cases = {"ua": True, "sua": True, "uaua": True, "a": False, "u": False, "uu": False, "usa": False, "suaa": False, "uax": False}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(c, i, names[r], "t") for c, roles in enumerate(cases) for i, r in enumerate(roles)]
    for block in (1, 2, 64):
        got = formatted(spark, rows, block=block)
        assert [got[c].valid for c in range(len(cases))] == list(cases.values())


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, None, "user", "first"), (2, 0, None, ""), (None, 0, "user", "q"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, -5, "user", "x" * 300_000)]
    got = formatted(spark, rows)
    assert [(b.role, b.text) for b in got[1].back] == [("user", "first"), ("assistant", "")]
    assert [(b.role, b.text) for b in got[2].back] == [("", "")]
    assert [b.text for b in got[3].back] == ["a", "a", "b"] and None in got and len(got[4].out) > 300_000
    assert formatted(spark, []) == {}


def test_long_conversation_is_made_in_blocks(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(1000)]
    r = formatted(spark, rows)[1]
    assert r.valid and [b.text for b in r.back] == [str(i) for i in range(1000)]


def test_template_must_be_escapable():
    with pytest.raises(ValueError):
        chat.Template(start="[INST]")
