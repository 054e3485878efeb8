"""Quality classifier (operator 6): hashed word n-gram logistic regression.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of other ASCII
characters, case kept.  1- to 3-grams of tokens are hashed into ``2**bits``
buckets; a token that repeats the one before it enters n-grams as one fixed
token, so that stuttering text shares features whatever its word is.  A
document's features are its n-gram frequencies times ``scale``.  Weights are
learned by follow-the-regularised-leader (FTRL-proximal) updates over a bounded
sample of labelled rows: their features are made where the rows are, and only
those, packed, meet in the one task that learns.  Scores are sparse dot products
computed for whole Arrow slices at once.

Bound: training takes at most ``sample`` labelled rows, those with the smallest
hash of doc_id, never rows of the held-out fold, and one row of each doc_id (of
several, the one with the smallest features); a row's features have at most
``2**bits`` buckets, however long its text is.  All rows are scored, whole.

Cases: null text counts as empty and scores by the bias alone; null labels are
skipped, a doc_id labelled twice takes its highest label; without any label the
score is 0.5; a null doc_id is scored, with held_out false; repeated rows are
scored each by itself; a text of any length is read whole; an empty table gives
an empty result; columns besides doc_id and text are ignored, but for those asked
for by ``keep``, of which any named like the columns that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import held_out
from ._text import BYTE_CLASS, gram_hashes, runs, slices, span_hash, utf8

_SAME = np.uint64(0x5DEECE66D)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    orders: tuple[int, ...] = (1, 2, 3)
    scale: float = 8.0
    sample: int = 12_000
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.05
    #: Gradients of label 0, the rarer and more varied one, count so many times.
    zero_weight: float = 3.0
    threshold: float = 0.3


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram occurrence, all rows of a slice at once."""
    kind = BYTE_CLASS[data]
    starts, ends, row = runs(kind > 0, offsets, kind)
    h = span_hash(data, starts, ends)
    if len(h) > 1:
        h[1:] = np.where((h[1:] == h[:-1]) & (row[1:] == row[:-1]), _SAME, h[1:])
    found = [gram_hashes(h, row, k) for k in s.orders]
    return np.concatenate([(g ^ np.uint64(k)) >> np.uint64(64 - s.bits) for k, (g, _) in zip(s.orders, found, strict=True)]).astype(np.int64), np.concatenate([r for _, r in found])


def packed(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """doc_id, _y and the features of each text: bucket numbers, then counts, 32 bits each."""
    for whole in batches:
        for batch in slices(whole, "text"):
            at, row = features(*utf8(batch.column("text")), s)
            pairs, count = np.unique(row * (1 << s.bits) + at, return_counts=True)
            cuts = np.searchsorted(pairs >> s.bits, np.arange(batch.num_rows + 1))
            at, count = (pairs & ((1 << s.bits) - 1)).astype(np.uint32), count.astype(np.uint32)
            blobs = [np.concatenate([at[a:b], count[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(blobs, pa.binary())], names=["doc_id", "_y", "features"])


def unpacked(blob: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and frequencies times ``scale``."""
    at, count = np.frombuffer(blob, np.uint32).reshape(2, -1)
    return at.astype(np.int64), count * (s.scale / max(1, int(count.sum())))


def ftrl(examples: list[tuple[bytes, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of FTRL-proximal updates over (packed features, label), in the order given."""
    size = (1 << s.bits) + 1  # the last one is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for blob, y in examples:
            at, value = unpacked(blob, s)
            i, x = np.append(at, size - 1), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x * (1 if y else s.zero_weight)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> tuple[np.ndarray, float]:
    """Fits on labelled rows outside the held-out fold; only the bounded weight table reaches the driver."""
    s = s or Settings()
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    kind = dict(docs.dtypes)["doc_id"]
    made = rows.select("doc_id", "_y", "text").mapInArrow(lambda batches: packed(batches, s), f"doc_id {kind}, _y int, features binary")
    one = made.groupBy("doc_id").agg(F.max("_y").alias("_y"), F.min("features").alias("features"))

    def fit(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        order = np.lexsort((ids, pd.util.hash_array(ids)))
        blobs, y = table.column("features"), np.asarray(table.column("_y")) > 0
        w, bias = ftrl([(blobs[int(i)].as_buffer(), int(y[i])) for i in order], s)
        keep = np.flatnonzero(w)
        return pa.table({"i": pa.array(np.append(keep, -1)), "w": pa.array(np.append(w[keep], bias))})

    w, bias = np.zeros(1 << s.bits), 0.0
    for i, x in one.groupBy(F.lit(0).alias("_all")).applyInArrow(fit, "i long, w double").toPandas().itertuples(index=False):
        if i < 0:
            bias = x
        else:
            w[i] = x
    return w, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, held_out, score and predicted (in place of any of that name) for every row of ``docs``; no shuffle."""
    s = s or Settings()
    keep = tuple(c for c in keep if c.lower() not in ("held_out", "score", "predicted"))
    w, bias = np.asarray(model[0], np.float64), model[1]
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                data, offsets = utf8(batch.column(text))
                at, row = features(data, offsets, s)
                n = batch.num_rows
                total = np.bincount(row, w[at], n)
                count = np.bincount(row, minlength=n)
                p = 1 / (1 + np.exp(-np.clip(bias + s.scale * total / np.maximum(count, 1), -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "held_out")), pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], names=[*keep, "held_out", "score", "predicted"])

    text = "text" if "text" in keep and dict(docs.dtypes)["text"] == "string" else "_rl_text"  # sent once
    rows = docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), *([F.col("text").cast("string").alias("_rl_text")] if text == "_rl_text" else []))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, "held_out")) + ", score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score (label 1 likelier when higher), predicted."""
    return score(docs, train(docs, labels, s), s)
