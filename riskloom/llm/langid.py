"""Language ID (operator 8): multilingual mixture inference.

Every language has a smoothed distribution over hashed byte 1- to 4-grams of
lower-cased text (words padded by spaces).  A document is a mixture: the
expectation-maximisation algorithm estimates its language proportions from the
n-gram likelihoods.  The set of languages is selected by penalised likelihood:
starting from the best single language, a language is added while the gain in
log likelihood exceeds ``penalty`` * log(n-grams), then proportions are final.
The prediction is the language of the largest proportion, the score that share.

Learned from at most ``per_lang`` documents a language, those with the smallest
hash of doc_id, never rows of the held-out fold; all rows are predicted, whole.

Cases: null text or text without a letter: ``und`` with score 0; without any
learned language everything is ``und``; null lang is not learned; ties between
languages go to the first in code-point order; rows are judged one by one,
repeated or not, whatever their doc_id, and read whole; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import held_out

_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    per_lang: int = 600
    smoothing: float = 0.5
    rounds: int = 12
    penalty: float = 2.0
    #: Neighbouring n-grams overlap; only this part of their likelihood counts as independent.
    independent: float = 0.3


def grams(text: str, bits: int) -> np.ndarray:
    """Counts of hashed 1- to 4-grams over the letters of a text, as a dense vector of 2**bits."""
    a = np.frombuffer(f" {_GAPS.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    code, shift, out = a.copy(), np.uint32(32 - bits), []
    for n in range(1, 5):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | a[n - 1 :]
        out.append((code * np.uint32(2654435761) + np.uint32(n * 40503 * 65537 & 0xFFFFFFFF)) >> shift)
    return np.bincount(np.concatenate(out), minlength=1 << bits)


def learn(docs: DataFrame, s: Settings | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their log-probability rows (languages x buckets)."""
    s = s or Settings()
    ids = (
        docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
        .select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"))
    )
    # a first cut by hash value keeps the ranked set small: the smallest hashes of a salt, then of the language
    salted = Window.partitionBy("lang", F.pmod("_h", F.lit(8))).orderBy("_h", "doc_id")
    ranked = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = (
        ids.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= s.per_lang)
        .withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= s.per_lang)
        .select("doc_id").distinct()
    )
    sample = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and _LETTER.search(text):
                    v = grams(text, s.bits)
                    v = v / v.sum()
                    sums[lang] = sums[lang] + v if lang in sums else v
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(v[at])], names=["lang", "i", "v"])

    table = sample.mapInArrow(count, "lang string, i long, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    langs = sorted(table["lang"].unique())
    model = np.zeros((len(langs), 1 << s.bits))
    for k, lang in enumerate(langs):
        part = table[table["lang"] == lang]
        model[k, part["i"]] = part["v"]
    if langs:
        mass = model.sum(axis=1, keepdims=True)
        floor = s.smoothing / (1 << s.bits)
        model = np.log((model / mass * 100 + floor) / (100 + s.smoothing))
    return langs, model.astype(np.float32)


def mixture(like: np.ndarray, count: np.ndarray, s: Settings) -> np.ndarray:
    """Proportions of the selected languages; ``like`` holds log likelihoods (languages x distinct n-grams)."""
    k = len(like)
    p = np.exp(like - like.max(axis=0))
    weight = count * s.independent
    price = s.penalty * np.log(max(2.0, weight.sum()))

    def fit(chosen: list[int]) -> tuple[float, np.ndarray]:
        share, q = np.full(len(chosen), 1 / len(chosen)), p[chosen]
        for _ in range(s.rounds if len(chosen) > 1 else 1):
            total = share @ q
            share = share * (q @ (weight / total)) / weight.sum()
        return float(weight @ np.log(share @ q)), share

    chosen = [int(np.argmax(like @ weight))]
    best, share = fit(chosen)
    while len(chosen) < k:
        trials = [(fit([*chosen, j]), j) for j in range(k) if j not in chosen]
        (gain, new), j = max(trials, key=lambda x: (x[0][0], -x[1]))
        if gain - best <= price:
            break
        best, share, chosen = gain, new, [*chosen, j]
    out = np.zeros(k)
    out[chosen] = share
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the estimated proportions as a map; no shuffle."""
    s = s or Settings()
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for batch in batches:
            best, score, mixed = [], [], []
            for text in map(pa.StringScalar.as_py, batch.column("_text")):
                if not langs or not text or not _LETTER.search(text):
                    best.append("und"), score.append(0.0), mixed.append("")
                    continue
                v = grams(text, s.bits)
                at = np.flatnonzero(v)
                share = mixture(logp[:, at].astype(np.float64), v[at].astype(np.float64), s)
                top = int(np.argmax(share))
                best.append(langs[top])
                score.append(float(min(1.0, share[top])))
                mixed.append(",".join(f"{langs[i]}:{share[i]:.3f}" for i in np.flatnonzero(share > 0)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, mixture string")


def language_id(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    return predict(docs, learn(docs, s), s)
