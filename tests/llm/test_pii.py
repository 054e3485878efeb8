import random
import re

from corpus_text import prose
from pyspark.sql import functions as F

from riskloom.llm import pii

#: The patterns as they are defined; the operator's are possessive forms of them.
DEFINED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(DEFINED.items()) for m in re.finditer(p, text) if passes(kind, m.group()))


def test_random_texts(make):
    rng = random.Random(1)
    parts = ["a", "b.", "@", "x@y.z", ".com", "1", "2", "40", " ", "-", "+", "(", ")", "255", "256", "1.2.3", "é", "\n", "4111 1111 1111 1111", "+1 415 555 0100", "_", "%", "😀"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(50))) for i in range(1500)}
    got = {r.doc_id: [(x.start, x.kind, x.end) for x in r.base] for r in pii.find_spans(make(texts)).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}
    assert sum(map(len, got.values())) > 1000


def test_long_runs_take_linear_time(make):
    texts = {1: "a" * 300_000 + " 1" * 200_000, 2: "a." * 200_000 + "@b.c", 3: "1." * 200_000, 4: "+1 " * 100_000, 5: "4111-" * 100_000}
    got = {r.doc_id: r for r in pii.find_spans(make(texts)).collect()}
    assert [(x.start, x.end) for x in got[2].base] == [(0, 400_004)] and not got[1].base


def test_labels_and_order(make):
    row = pii.find_spans(make({1: "é 10.0.0.1 a@b.cd +1 (415) 555-0100, 4111 1111 1111 1111"})).select(pii.labels(F.col("base")).alias("x")).first()
    assert row.x == "ip:2:10,email:11:17,phone:18:35,card:37:56"


def test_terms_that_give_an_entity_away(make):
    rng = random.Random(6)
    texts = {i: prose(rng, 30) for i in range(200)}
    for i in range(6):
        texts[300 + i] = prose(rng, 10) + " Rosebud plus with 10.1.2.3 here " + prose(rng, 8)
    for i in range(40):
        texts[400 + i] = prose(rng, 5) + " with plus here " + prose(rng, 5)
    docs = make(texts)
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    terms = {texts[d][t.start : t.end] for d, r in found.items() for t in r.terms}
    assert terms == {"Rosebud"}
    assert all(found[300 + i].terms for i in range(6)) and not any(found[i].terms for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Rosebud" not in clean[300] and "[IP]" in clean[300] and "10.1.2.3" not in clean[300] and clean[5] == texts[5]
    # the shuffled join gives the same
    again = {r.doc_id: r.terms for r in pii.find_spans(docs, pii.Settings(broadcast_terms=-1)).collect()}
    assert again == {d: r.terms for d, r in found.items()}


def test_copies_prove_nothing(make):
    text = "Rosebud writes from 10.1.2.3 today"
    assert not any(r.terms for r in pii.find_spans(make({i: text for i in range(50)})).collect())


def test_odd_rows(make):
    docs = make([(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd")]).withColumn("base", F.lit("mine")).withColumn("_hash", F.lit("mine"))
    assert sorted(len(r.base) for r in pii.find_spans(docs).collect()) == [0, 0, 1, 1, 1]
    got = pii.sanitise(docs)
    assert sorted(("null" if r.text is None else r.text, r.base, r._hash) for r in got.collect()) == sorted([("null", "mine", "mine"), ("", "mine", "mine"), *[("[EMAIL]", "mine", "mine")] * 3])
    assert pii.find_spans(make({})).count() == 0


def test_terms_of_two_documents(make):
    rng = random.Random(9)
    texts = {i: prose(rng, 30) for i in range(300)}
    for i in (400, 401):
        texts[i] = f"{prose(rng, 9)} Qo a@b.cd {prose(rng, 9)}"
    copy = f"{prose(rng, 9)} Rosebud x@y.zz {prose(rng, 9)}"
    texts |= {402: copy, 403: copy}
    texts[404] = f"{prose(rng, 9)} Once q@r.st q@r.st {prose(rng, 9)}"
    found = {r.doc_id: r for r in pii.find_spans(make(texts)).collect()}
    assert {texts[d][t.start : t.end] for d, r in found.items() for t in r.terms} == {"Qo"}
    assert len(found[400].terms) == len(found[401].terms) == 1


def test_words_that_the_window_cuts_are_no_terms(make):
    rng = random.Random(10)
    texts = {i: prose(rng, 30) for i in range(300)}
    for i in range(4):  # 'bud' is all that the window of 80 characters holds of the longer word
        texts[400 + i] = f"rosebud {'1' * 74}{i} a@b.cd {prose(rng, 2)}"
    texts[500] = "bud"
    assert not any(r.terms for r in pii.find_spans(make(texts)).collect())
    texts |= {400 + i: f"rose bud {'1' * 74}{i} a@b.cd" for i in range(4)} | {500: "rose"}
    found = {r.doc_id: r for r in pii.find_spans(make(texts)).collect()}
    assert {texts[d][t.start : t.end] for d, r in found.items() for t in r.terms} == {"bud"}
