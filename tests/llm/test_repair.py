import heapq
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, block string"
PAIR = {0: 2, 1: 2, 2: 3, 3: 2}
WHITE = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    """Rows in order with their fault."""
    import hashlib

    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for t, r, x in rows:
        bare = x.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((t, r, x, fault))
    return out


def plain_repair(rows):
    """Least cost, then least audit, by searching edits one at a time; inserts are edits of their own."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        if (at, state) in done:
            continue
        done.add((at, state))
        made = "assistant" if state == 2 else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", at, PAIR[state], (*out, (made, ""))))
        if at == len(rows):
            continue
        _, r, x, fault = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        late = 3 * (fault == "truncated")
        heapq.heappush(heap, (cost + 3 + late, audit + "R", at + 1, PAIR[state], (*out, (made, x))))
        if r[:1] == "s" and state == 0 or r[:1] == "u" and state != 2 or r[:1] == "a" and state == 2:
            heapq.heappush(heap, (cost + late, audit + "K", at + 1, 1 if r[:1] == "s" else PAIR[state], (*out, (r, x))))


def plain(rows):
    marked = plain_faults(rows)
    cost, audit, out = plain_repair(marked)
    turns = [t for t, *_ in marked if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    return (gaps, *n, illegal, cost, audit, out)


def repaired(spark, conversations, **k):
    rows = [(c, *r, "mine", "mine") for c, turns in conversations.items() for r in turns]
    random.Random(4).shuffle(rows)
    got = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), **k).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [(x.role, x.text) for x in r.repaired]) for r in got}
    assert len(out) == len(got)
    return out


def turns_of(rng, n):
    roles = ["system"] + ["user", "assistant"] * 4 + ["tool", "", None, "ü", "sys", "ushr"]
    texts = ["Yes.", "No!", "So?", "cut off", "cut", "", " \n", None, "ends. \t", "é."]
    return [(rng.choice([i, i, i, None, i - 1]), rng.choice(roles), f"{i} " * rng.randrange(2) + (rng.choice(texts) or "") if rng.random() < 0.9 else None) for i in range(n)]


@pytest.mark.parametrize(("block", "per_batch"), [(256, 50_000), (3, 40), (1, 7)])
def test_same_as_a_search(spark, block, per_batch):
    rng = random.Random(block)
    data = {c: turns_of(rng, rng.randrange(1, 10)) for c in range(120)} | {None: turns_of(rng, 5), -7: turns_of(rng, 60)}
    got = repaired(spark, data, block=block, per_batch=per_batch)
    assert got == {c: plain(rows) for c, rows in data.items()}


def test_moves_and_ends_are_whole():
    ways = repair.moves()
    assert len(ways) == len(set(ways)) and {w[1] for w in ways} == set("suaSUA?!-")
    assert all(set(w[4]) <= set("DIKR") and len(w[4].lstrip("I")) == 1 for w in ways)
    assert {(s, e) for s, _, e in repair.ends()} == {(0, ""), (0, "II"), (1, "II"), (2, "I"), (3, "")}


def test_known_cases(spark):
    ok = [(0, "user", "Hi."), (1, "assistant", "Yes.")]
    got = repaired(spark, {1: ok, 2: [(0, "system", "Be."), *[(t + 1, r, x) for t, r, x in ok]], 3: [(0, "assistant", "A.")], 4: [(0, "user", "")], 5: [(0, "user", "Q."), (0, "user", "Q."), (5, "assistant", "no end")]})
    assert got[1] == (0, 0, 0, 0, 0, 0, "KK", [("user", "Hi."), ("assistant", "Yes.")])
    assert got[2][5:7] == (0, "KKK") and got[3][5:7] == (3, "IK") and got[4][5:] == (4, "D", [])
    assert got[5][:7] == (4, 0, 1, 1, 1, 7, "KDK")


def test_one_long_conversation_is_many_blocks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["user", "assistant"]), f"{i}." if rng.random() < 0.8 else f"{i}") for i in range(1500)]
    assert repaired(spark, {1: rows}, block=64, per_batch=300)[1] == plain(rows)


def test_damage(spark):
    from zlib import crc32

    rows = [(c, t, r, x, "", "") for c in range(40) for t, r, x in [(0, "user", "A. b!"), (1, "assistant", None), (None, None, "z?")]]
    want = []
    for c, t, r, x, *_ in rows:
        k = crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = [tuple(r) for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_tables(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 200_000 + "end."
    got = repaired(spark, {1: [(0, "user", long), (0, "user", long), (1, "assistant", "ok.")], 2: [(None, "user", "a."), (None, "user", "a.")]})
    assert got[1][6:] == ("KDK", [("user", long), ("assistant", "ok.")]) and got[2][0] == 0 and got[2][2] == 1
    same = repaired(spark, {1: [(3, "user", "again.")] * 700}, block=16)[1]
    assert same[:7] == (0, 0, 699, 0, 699, 4 * 699 + 3, "K" + "D" * 699 + "I")
    assert repair.repair(spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn int, role string, text string").withColumn("cost", F.lit("x"))).count() == 1
