"""Toxicity (operator 12): gradient-boosted trees over dense features, with isotonic calibration.

Features are rates of a text's words and characters: hits of a fixed lexicon of
insults and of a learned one, hits near a second person, capitals, punctuation,
obfuscated words, and the length.  Words are compared folded: lower case,
punctuation dropped, digits and signs that stand for letters read as those,
repeated letters taken once, single letters in a row taken together; so
``1d10t!!``, ``i.d.i.o.t`` and ``i d i o o t`` are hits.

The learned lexicon holds words and beginnings of words that toxic texts hold more
often than chance explains (a Chernoff bound of ``nats``), behind many different
words, so that a passage which copies share doesn't enter.  Spark counts it over
two halves of the training rows: a row's features come from the lexicon of the
other half, those of the rows to score from all.  Trees are boosted by Newton
steps on the logistic loss over binned features, and the margins that rows get
from trees of other folds are calibrated by isotonic regression.  What meets in
the one task that learns is a few numbers a row.  All rows are scored, whole,
without a shuffle.

Bound: training takes at most ``sample`` labelled rows, those with the smallest
hash of doc_id, never rows of the held-out fold, and one row of each doc_id (the
one with the smallest features); a lexicon has the ``terms`` strongest at most.

Cases: null text counts as empty; null labels are skipped, and a doc_id labelled
twice takes its highest label; with labels of one kind only, or none, the score is
their mean, or 0; a null doc_id is scored, with held_out false; repeated rows are
scored each by itself; a text of any length is read whole, in pieces of
``PIECE`` bytes cut at white space, across which words are not near each other;
an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, held_out
from ._text import IS_WORD, runs, slices, span_hash, utf8

# Insults of four languages, words that address someone, signs read as letters.
INSULTS = """idiot moron stupid dumb dumbass loser scum trash worthless pathetic disgusting clown imbecile jerk freak garbage vermin bastard bitch
asshole shit fuck fucking cunt whore slut retard idioten dummkopf arschloch scheisse trottel hurensohn wichser abschaum connard salaud imbécile
crétin abruti merde ordure salope idiota imbécil estúpido estúpida gilipollas cabrón mierda basura pendejo asqueroso""".split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr tu toi ton ta vous votre tú usted ti vos eres".split()
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

PIECE = 1 << 20
NEAR = 5
#: Bytes of the beginnings of words that may be learned, besides whole words.
STEMS = (3, 4, 5, 6, 8)
NAMES = (
    "insults", "learned", "log_insults", "log_learned", "addressed_hits", "second_person", "capitals", "shouted", "exclaimed", "punctuation", "repeated_marks",
    "obfuscated", "obfuscated_hits", "log_words",
)


def _table(members: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode() if isinstance(members, str) else members)] = True
    return out


_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_LETTER, _DIGIT, _MARK = _UPPER | _LOWER, _table("0123456789"), _table("!?")
_BROAD = _LETTER | np.r_[np.zeros(128, bool), np.ones(128, bool)]
_MASK = _table("0123456789@$*!#%")
_PUNCT = IS_WORD & ~_BROAD & ~_DIGIT
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[_UPPER] += 32
_FOLD = _LOWERED.copy()
for sign, letter in SIGNS.items():
    _FOLD[ord(sign)] = ord(letter)


@dataclass(frozen=True)
class Settings:
    sample: int = 12_000
    terms: int = 2_000
    nats: float = 20.0
    min_contexts: int = 5
    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    l2: float = 1.0
    min_rows: int = 5
    folds: int = 3
    threshold: float = 0.5


def _per_row(count: int, row: np.ndarray, what: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row if what is None else row[what], minlength=count).astype(np.float64)


@dataclass
class Words:
    """The words of a slice: hashes of the folded word, of its letters and of their beginnings (0: as long as the word), rows, and what the characters tell."""

    folded: np.ndarray
    plain: np.ndarray
    stems: np.ndarray
    row: np.ndarray
    shouted: np.ndarray
    masked: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, row = runs(IS_WORD[data], offsets)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return Words(none, none, np.zeros((len(STEMS), 0), np.uint64), row, none > 0, none > 0)
    ahead, behind = np.append(data[1:], 32), np.append(32, data[:-1])
    inner = (_BROAD | _DIGIT)[ahead]
    sign = _table("@$!")[data]
    keep = (_BROAD | _DIGIT)[data] | sign & inner
    # capitals of Latin-1, two bytes in UTF-8
    capital = ((behind == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)).astype(np.uint8) << 5
    low = _FOLD[data] + capital
    upto = np.append(0, np.cumsum(keep))
    letters = _BROAD[data]
    lupto = np.append(0, np.cumsum(letters))
    begin, stop = lupto[starts], lupto[ends]
    cuts = np.stack([stop, *(np.minimum(begin + k, stop) for k in STEMS)])
    plain, *stems = span_hash((_LOWERED[data] + capital)[letters], np.tile(begin, len(cuts)), cuts.ravel()).reshape(cuts.shape)
    stems = np.where(cuts[1:] < stop, np.stack(stems), np.uint64(0))
    # repeated letters once: a kept byte that equals the kept one before it in its word goes
    kept, word_of = low[keep], np.searchsorted(starts, np.flatnonzero(keep), "right")
    fresh = np.append(True, (kept[1:] != kept[:-1]) | (word_of[1:] != word_of[:-1]) | (kept[1:] >= 128))
    fupto = np.append(0, np.cumsum(fresh))
    first, last = fupto[upto[starts]], fupto[upto[ends]]
    text = kept[fresh]
    # single letters in a row of at least four make one word, told at the first of them
    alone = last - first == 1
    same = np.append(False, alone[1:] & alone[:-1] & (row[1:] == row[:-1]))
    head = np.flatnonzero(alone & ~same)
    if len(head):
        tail = np.searchsorted(np.flatnonzero(~same), head, "right")
        stops = np.append(np.flatnonzero(~same), len(starts))[tail]
        long = stops - head >= 4
        once = last.copy()
        once[head[long]] = last[stops[long] - 1]
        last = once
    folded = span_hash(text, first, last)
    total = lambda member: np.diff(np.append(0, np.cumsum(member))[np.stack([starts, ends])], axis=0)[0]
    upper, ascii_letters = total(_UPPER[data]), total(_LETTER[data])
    masked = (total(_MASK[data] & (_LETTER | _DIGIT)[ahead]) > 0) & (ascii_letters > 0)
    return Words(folded, plain, stems, row, (upper >= 3) & (upper == ascii_letters), masked)


def hashes(terms: list[str]) -> np.ndarray:
    """Folded hashes of words, sorted."""
    data, offsets = utf8(pa.array(terms))
    return np.unique(words(data, offsets).folded)


def _plain_hashes(terms: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(terms))
    return np.unique(words(data, offsets).plain)


_INSULTS, _ADDRESS, _AS_WRITTEN = hashes(INSULTS), _plain_hashes(SECOND_PERSON), _plain_hashes(INSULTS)


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(h.shape, bool)


def counts(data: np.ndarray, offsets: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """One line a row; all columns may be added over pieces of a text."""
    n = len(offsets) - 1
    w = words(data, offsets)
    insult, you = _in(w.folded, _INSULTS), _in(w.plain, _ADDRESS)
    term = _in(w.plain, learned) | _in(w.stems, learned).any(0)
    hit, at = insult | term, np.flatnonzero(you)
    near = np.zeros(len(hit), bool)
    if len(at) and hit.any():
        here = np.flatnonzero(hit)
        for side in (np.searchsorted(at, here, "left") - 1, np.searchsorted(at, here, "right")):
            other = at[np.clip(side, 0, len(at) - 1)]
            near[here] |= (side >= 0) & (side < len(at)) & (np.abs(other - here) <= NEAR) & (w.row[other] == w.row[here])
    byte_row = np.repeat(np.arange(n), np.diff(offsets))
    begun = np.append(True, byte_row[1:] != byte_row[:-1]) if len(data) else np.zeros(0, bool)
    twice = _PUNCT[data] & (np.append(0, data[:-1]) == data) & ~begun if len(data) else begun
    of_words = [insult, term, hit & near, you, w.shouted, w.masked, hit & ~_in(w.plain, _AS_WRITTEN) & w.masked]
    of_bytes = [_UPPER[data], _LETTER[data], _MARK[data], _PUNCT[data], twice, (data & 0xC0) != 0x80]
    return np.stack([_per_row(n, w.row), *(_per_row(n, w.row, x) for x in of_words), *(_per_row(n, byte_row, x) for x in of_bytes)], 1)


def rates(c: np.ndarray) -> np.ndarray:
    """The features of ``NAMES`` from ``counts``."""
    n, insult, term, near, you, shouted, masked, hidden, upper, letters, marks, punct, twice, chars = c.T
    per_word, per_char = 100 / np.maximum(n, 1), 100 / np.maximum(chars, 1)
    return np.stack([
        insult * per_word, term * per_word, np.log1p(insult), np.log1p(term), near * per_word, you * per_word, upper / np.maximum(letters, 1), shouted * per_word,
        marks * per_char, punct * per_char, twice * per_char, masked * per_word, hidden * per_word, np.log1p(n),
    ], 1)


def _pieces(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long text in pieces of at most ``limit`` bytes, cut behind white space where there is any."""
    at = 0
    while len(data) - at > limit:
        blank = np.flatnonzero(~IS_WORD[data[at : at + limit]])
        end = at + (int(blank[-1]) + 1 if len(blank) else limit)
        yield data[at:end]
        at = end
    yield data[at:]


def features(texts: pa.Array, learned: np.ndarray, limit: int = PIECE) -> np.ndarray:
    """Features of every text of a slice."""
    data, offsets = utf8(texts)
    if len(texts) == 1 and len(data) > limit:
        return rates(sum(counts(x, np.array([0, len(x)]), learned) for x in _pieces(data, limit)))
    return rates(counts(data, offsets, learned))


# ---- learning ----


def boosted(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[list, float]:
    """Trees (feature, cut for each inner node, level by level, and values of the leaves) and the first margin."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    margin, trees, width = np.full(len(y), base), [], s.bins
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, inner = np.zeros(len(y), np.int64), []
        for level in range(s.depth):
            size = 1 << level
            best = np.full(size, 1e-9)
            pick = np.full((size, 2), -1)
            for f in range(x.shape[1]):
                key = node * width + binned[:, f]
                left = [np.bincount(key, weight, size * width).reshape(size, width).cumsum(1) for weight in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = left, [z[:, -1:] for z in left]
                part = lambda a, b: a * a / (b + s.l2)
                gain = np.where((nl >= s.min_rows) & (nt - nl >= s.min_rows), part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht), 0)
                at = gain.argmax(1)
                better = gain[np.arange(size), at] > best
                best = np.where(better, gain[np.arange(size), at], best)
                pick[better] = np.stack([np.full(size, f), at], 1)[better]
            inner += [(int(f), float(cuts[f][b]) if f >= 0 and b < len(cuts[f]) else float("inf")) for f, b in pick]
            f, b = pick[node].T
            node = node * 2 + ((f >= 0) & (binned[np.arange(len(y)), f] > b))
        leaves = -s.rate * np.bincount(node, g, 1 << s.depth) / (np.bincount(node, h, 1 << s.depth) + s.l2)
        margin = margin + leaves[node]
        trees.append((inner, leaves.tolist()))
    return trees, base


def margins(x: np.ndarray, model: tuple[list, float]) -> np.ndarray:
    trees, base = model
    out = np.full(len(x), base)
    for inner, leaves in trees:
        feature, cut = np.array([f for f, _ in inner]), np.array([c for _, c in inner])
        node = np.zeros(len(x), np.int64)
        for level in range(len(leaves).bit_length() - 1):
            at = (1 << level) - 1 + node
            node = node * 2 + ((feature[at] >= 0) & (x[np.arange(len(x)), feature[at]] > cut[at]))
        out += np.asarray(leaves)[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the increasing function closest to ``y``: pooled adjacent violators, between whose means scores are interpolated."""
    at, inverse = np.unique(margin, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for v, w, m in zip(value, weight, at, strict=True):
        blocks.append([v, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = [(m, b[0]) for b in blocks for m in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return [float(m) for m, _ in knots], [float(v) for _, v in knots]


def fitted(x: np.ndarray, y: np.ndarray, fold: np.ndarray, s: Settings) -> dict:
    """Trees on all rows; calibration on margins that each fold's rows get from trees of the other folds."""
    if not len(y) or y.min() == y.max():
        return {"trees": [], "base": 0.0, "knots": [[0.0], [float(y.mean()) if len(y) else 0.0]]}
    apart = np.zeros(len(y))
    for k in range(s.folds):
        mine = fold % s.folds == k
        apart[mine] = margins(x[mine], boosted(x[~mine], y[~mine], s)) if (~mine).any() else 0.0
    trees, base = boosted(x, y, s)
    return {"trees": trees, "base": base, "knots": isotonic(apart, y)}


def train(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> tuple[np.ndarray, dict]:
    """The learned lexicon (hashes) and the trees with their calibration; only these reach the driver."""
    s = s or Settings()
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    )
    # a bounded number of ids on the broadcast side; the texts of the sample are read twice
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(1 << 20)).cast("int")
    rows = durable(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "_y", fold.alias("_fold"), "text"))

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words and beginnings of each text, with a bit for the word before."""
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words(*utf8(batch.column("text")))
                bits = np.left_shift(np.uint64(1), np.append(np.uint64(0), w.plain)[:-1] % np.uint64(64))
                every = np.concatenate([w.plain[None], w.stems])
                found = pd.DataFrame({"row": np.tile(w.row, len(every)), "term": every.ravel(), "bits": np.tile(bits, len(every))})
                found = found[found["term"] != 0].drop_duplicates(["row", "term"])
                y, half = (np.asarray(batch.column(c))[found["row"]] for c in ("_y", "_fold"))
                values = [pa.array(found[c].to_numpy().view(np.int64)) for c in ("term", "bits")]
                yield pa.RecordBatch.from_arrays([*values, pa.array(y, pa.int32()), pa.array(half & 1, pa.int32())], names=["term", "bits", "y", "half"])

    whole = {(r._half, r._y): r["count"] for r in rows.groupBy((F.col("_fold") % 2).alias("_half"), "_y").count().collect()}
    seen = lambda half, y: F.count(F.when((F.col("half") == half) & (F.col("y") == y), 1)).alias(f"n{half}{y}")
    behind = lambda half: F.bit_or(F.when((F.col("y") == 1) & (F.col("half") == half), F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"c{half}")
    counted = rows.select("_y", "_fold", "text").mapInArrow(said, "term long, bits long, y int, half int").groupBy("term").agg(seen(0, 0), seen(0, 1), seen(1, 0), seen(1, 1), behind(0), behind(1))
    counted = durable(counted.where(F.col("n01") + F.col("n11") >= s.min_contexts))

    def lexicon(halves: tuple[int, ...]) -> np.ndarray:
        """The strongest terms of the rows of ``halves``."""
        toxic, other = (sum(whole.get((h, y), 0) for h in halves) for y in (1, 0))
        if not toxic or not other:
            return np.zeros(0, np.uint64)
        n1, n0 = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)).cast("double") for y in (1, 0))
        bits = F.col("c0").bitwiseOR(F.col("c1")) if len(halves) > 1 else F.col(f"c{halves[0]}")
        rate, share = toxic / (toxic + other), n1 / (n1 + n0)
        bound = n1 * F.log(share / rate) + F.when(n0 > 0, n0 * F.log((1 - share) / (1 - rate))).otherwise(0.0)
        strong = counted.where((n1 > 0) & (share > rate) & (F.bit_count(bits) >= s.min_contexts)).withColumn("bound", bound).where(F.col("bound") >= s.nats)
        found = [r.term for r in strong.where(share >= 0.5).orderBy(F.desc("bound"), "term").limit(s.terms).select("term").collect()]
        return np.unique(np.array(found, np.int64).view(np.uint64))

    learned, other_half = lexicon((0, 1)), (lexicon((1,)), lexicon((0,)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                half = np.asarray(batch.column("_fold")) & 1
                x = np.where((half == 0)[:, None], *(features(batch.column("text"), known) for known in other_half))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), batch.column("_fold"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "_y", "_fold", "x"])

    made = rows.mapInArrow(measured, "doc_id string, _y int, _fold int, x array<double>")
    one = made.groupBy("doc_id").agg(F.max("_y").alias("_y"), F.max("_fold").alias("_fold"), F.min("x").alias("x"))

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_id").to_numpy(zero_copy_only=False))
        x = np.array(table.column("x").to_pylist(), float).reshape(table.num_rows, len(NAMES))[order]
        model = fitted(x, (np.asarray(table.column("_y")) > 0).astype(float)[order], np.asarray(table.column("_fold"))[order] >> 1, s)
        return pa.table({"model": [json.dumps(model)]})

    got = one.groupBy(F.lit(0).alias("_all")).applyInArrow(fit, "model string").collect()
    return learned, json.loads(got[0].model) if got else fitted(np.zeros((0, len(NAMES))), np.zeros(0), np.zeros(0, int), s)


def score(docs: DataFrame, learned: np.ndarray, model: dict, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and the features for every row of ``docs``; no shuffle."""
    s = s or Settings()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"), learned)
                p = np.interp(margins(x, (model["trees"], model["base"])), *model["knots"])
                values = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= s.threshold).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "held_out", "score", "predicted", "features"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, features array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score (label 1 likelier when higher), predicted, features (those of ``NAMES``)."""
    return score(docs, *train(docs, labels, s), s)
