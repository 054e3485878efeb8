"""Line dedup (operator 2): winnowing over line hashes.

The lines of a document that hold a word are hashed.  Windows are the shortest
runs of lines with ``min_words`` words or more, those that begin and those that
end at each line.  Of each window the line with the smallest key is its
fingerprint (lines of fewer than ``short`` words rank last, then by hash; the
rightmost of equals).  So every run of ``min_words`` words is guaranteed a
fingerprint at the same place wherever it occurs.

Fingerprints are joined with the other positions of the same line; those that
stand alone, most lines of a corpus, are done with.  From the others a match is
extended both ways to the ends of the windows that they are the fingerprints of,
by one hash for each window, and the first position of each window is found
(positions are ordered by doc_id, then text hash, then line).  Windows at later
positions are deleted.  Every longer repeated run is a union of such windows,
each of which occurs earlier too, so what is deleted are exactly the lines of
all runs of ``min_words`` words or more that have an earlier position, however
many partners a line has, overlapping runs in one document included.  The first
position of a window is never deleted, so every line survives once.

No pairs of positions are made: a line that a third of all documents share gives
one row for each occurrence, and both joins can split it over tasks.

Equal lines and windows are told by 64-bit hashes (a window by that of its
fingerprint, too).

Cases: null text counts as empty and stays null; lines without a word stand
with the line before them; empty, one-line and very long texts work the same;
an empty table gives an empty result; rows that repeat both doc_id and text
count as one document, and all are treated alike; a null doc_id sorts first;
ids are integers; other columns pass through, but for those named like the
counts that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable
from ._text import IS_WORD, _pow, mix, runs, slices, span_hash, utf8


@dataclass(frozen=True)
class Settings:
    min_words: int = 10
    short: int = 5


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, row and number of words of every line with a word, in order."""
    starts, ends, row = runs(data != 10, offsets)
    word_starts, _, _ = runs(IS_WORD[data], offsets)
    first = np.searchsorted(word_starts, starts)
    words = np.searchsorted(word_starts, ends) - first
    keep = words > 0
    return span_hash(data, starts[keep], ends[keep]), row[keep], words[keep]


def windows(h: np.ndarray, row: np.ndarray, words: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Hash, first and last index of the shortest runs of ``min_words`` words that begin or end at each line."""
    n = len(h)
    upto = np.r_[0, np.cumsum(words)]
    at = np.arange(n)
    end = np.searchsorted(upto, upto[:-1] + s.min_words, "left") - 1
    begin = np.searchsorted(upto, upto[1:] - s.min_words, "right") - 1
    lo, hi = np.r_[at, begin], np.r_[end, at]
    lo, hi = np.maximum(lo, 0), np.where(lo < 0, n, hi)
    inside = hi < n
    lo, hi = lo[inside], hi[inside]
    inside = row[lo] == row[hi]
    lo, hi = np.divmod(np.unique(lo[inside] * n + hi[inside]), max(n, 1))
    power, inverse = _pow(n + 1)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)]
    return mix((total[hi + 1] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)), lo, hi


def fingerprints(h: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: Settings) -> np.ndarray:
    """The index of the fingerprint of each window."""
    if not len(lo):
        return lo
    key = (h >> np.uint64(1)) | ((words < s.short).astype(np.uint64) << np.uint64(63))
    order = np.lexsort((-np.arange(len(h)), key))
    rank = np.empty(len(h) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(h)), len(h)
    return order[np.minimum.reduceat(rank, np.stack([lo, hi + 1], 1).ravel())[::2]]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


_PLACES = "h long, id long, text_key long, windows array<long>, lo array<int>, hi array<int>"


def _positions(docs: DataFrame, s: Settings) -> DataFrame:
    """h (line hash), id, text_key of every fingerprint, and its windows: hash, first and last line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, row, words = lines_of(*utf8(batch.column("text")))
                window, lo, hi = windows(h, row, words, s)
                at = fingerprints(h, words, lo, hi, s)
                order = np.argsort(at, kind="stable")
                window, lo, hi, at = window[order], lo[order], hi[order], at[order]
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
                each, rows = at[cuts], pa.array(row[at[cuts]])
                begin = np.searchsorted(row, np.arange(batch.num_rows))[row[at]]
                grouped = lambda x, cuts=cuts, at=at: pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(at)].astype(np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[each].view(np.int64)), batch.column("id").take(rows), batch.column("text_key").take(rows),
                        grouped(window.view(np.int64)), grouped((lo - begin).astype(np.int32)), grouped((hi - begin).astype(np.int32)),
                    ],
                    names=["h", "id", "text_key", "windows", "lo", "hi"],
                )

    return _keyed(docs).mapInArrow(run, _PLACES)


def repeated_ranges(docs: DataFrame, s: Settings) -> DataFrame:
    """id, text_key, ranges (array of first line, last line) of windows that have an earlier position."""
    # the sides of both joins are written, so that a join deals them out by itself and can split a very common line
    places = durable(_positions(docs, s))
    met = durable(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    pairs = places.join(met, "h").select("h", "id", "text_key", F.explode(F.arrays_zip("windows", "lo", "hi")).alias("w"))
    runs = durable(pairs.select("h", F.col("w.windows").alias("window"), "id", "text_key", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")))
    firsts = durable(
        runs.groupBy("h", "window").agg(F.min(F.struct("id", "text_key", "lo")).alias("a"), F.count("*").alias("n"))
        .where("n > 1").select("h", "window", F.col("a.id").alias("a_id"), F.col("a.text_key").alias("a_key"), F.col("a.lo").alias("a_lo"))
    )
    first = F.col("id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key")) & (F.col("lo") == F.col("a_lo"))
    return runs.join(firsts, ["h", "window"]).where(~first).groupBy("id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def cut(text: str | None, ranges: list[dict]) -> tuple[str | None, int, int, int, int]:
    """(kept text, lines with a word, lines removed, words, words removed)."""
    if not text:
        return text, 0, 0, 0, 0
    lines = text.split("\n")
    counts = [len(x.encode().split()) for x in lines]
    words = np.array([c for c in counts if c], np.int64)
    drop = np.zeros(len(words), bool)
    for r in ranges:
        drop[r["lo"] : r["hi"] + 1] = True
    if not drop.any():
        return text, len(words), 0, int(words.sum()), 0
    number = np.cumsum([c > 0 for c in counts]) - 1  # the content line that each line stands with
    kept = [x for x, k in zip(lines, number, strict=True) if k < 0 or not drop[k]]
    return "\n".join(kept), len(words), int(drop.sum()), int(words.sum()), int(words[drop].sum())


ADDED = ("n_lines", "n_removed", "n_words", "n_words_removed")


def line_dedup(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and n_lines, n_removed, n_words, n_words_removed."""
    s = s or Settings()
    names = [c for c in docs.columns if c.lower() not in ADDED]
    ranges = repeated_ranges(docs, s).toDF("_rl_id", "_rl_key", "_rl_ranges")
    rows = docs.withColumn("text", F.col("text").cast("string"))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = rows.join(ranges, F.col("doc_id").cast("long").eqNullSafe(F.col("_rl_id")) & (key == F.col("_rl_key")), "left").select(*names, "_rl_ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(t.as_py(), r.as_py() or []) for t, r in zip(batch.column("text"), batch.column("_rl_ranges"), strict=True)]
            text, *counts = zip(*out, strict=True) if out else ([],) * 5
            columns = [pa.array(text, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], names=[*names, *ADDED])

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + "".join(f", {c} long" for c in ADDED))
