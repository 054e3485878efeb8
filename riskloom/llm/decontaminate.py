"""Benchmark decontamination (operator 1): SimHash over item-sized windows.

Words are lower-cased runs of letters, digits and non-ASCII characters.  For
each length of benchmark items, windows of that many words slide over the
document and get a SimHash of their five-word shingles, weighted by occurrences:
``blocks`` blocks of 16 bits.  A multi-index looks up each block of a window
among those of the items of its length.  Two fingerprints that differ in fewer
bits than there are blocks agree on one block at least, so all fingerprints
within a radius of ``blocks - 1`` bits are guaranteed; beyond it the chance to
agree on none falls with the distance.  At similarity 0.8 about 0.15 of the bits
differ, and 96 blocks miss less than 1 pair in 1,000, while two fingerprints
that have nothing to do with each other meet with a probability of 96 / 65,536.
Candidates are verified by exact weighted-shingle similarity (sum of the smaller
over sum of the larger occurrence counts) of ``threshold`` or more.

Windows are made only where they may reach the threshold: a window of n shingles
needs 2 * threshold / (1 + threshold) * n of them among those of the items, since
fewer can't be shared with any.  Nothing else is skipped.  Windows are made and
looked up in groups of bounded size, so memory doesn't grow with a text beyond
its own shingles.  Documents are never shuffled: the items are read in blocks of
at most ``block_items`` and ``block_chars``, whose index is broadcast, and a
larger benchmark takes more passes.

An item or text of one to four words has one shingle, of all its words; such an
item is only found in a text that equals it.  A text shorter than an item is
one window.

Cases: null or empty texts and items match nothing; an empty table of either
kind gives no leaks; equal items are found each; of equal windows the first
counts; rows are judged one by one, repeated or not, whatever their doc_id; a
text of any length is read whole; item ids are integers; other columns pass
through, but for one named leaks, which is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import durable
from ._text import BYTE_CLASS, gram_hashes, mix, runs, slices, span_hash, utf8


@dataclass(frozen=True)
class Settings:
    k: int = 5
    threshold: float = 0.8
    #: Blocks of 16 bits of a fingerprint, a multiple of 4.
    blocks: int = 96
    block_items: int = 20_000
    block_chars: int = 1 << 24
    gate_bits: int = 22
    #: Shingles whose bits are summed at once.
    group: int = 2_048


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in order, offsets of the rows in them, and word counts of the rows."""
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, row = runs(BYTE_CLASS[data] == 1, offsets)
    h = span_hash(data, starts, ends)
    n = len(offsets) - 1
    words = np.bincount(row, minlength=n)
    g, g_row = gram_hashes(h, row, k)
    for size in range(1, k):
        pick = words[row] == size
        if pick.any():
            sg, sr = gram_hashes(h[pick], row[pick], size)
            # marked by their size, so that short texts only equal short texts
            g, g_row = np.concatenate([g, sg ^ np.uint64(size)]), np.concatenate([g_row, sr])
    if n and 0 < words[words > 0].min(initial=k) < k:  # else they are in the order of the rows already
        order = np.argsort(g_row, kind="stable")
        g, g_row = g[order], g_row[order]
    return g, np.searchsorted(g_row, np.arange(n + 1)), words


def signs(g: np.ndarray, blocks: int) -> np.ndarray:
    """+1 or -1 for each bit of the fingerprint, by shingle: bits of hashes of the shingle hash."""
    seeds = np.arange(1, blocks // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.unpackbits(mix(g[:, None] ^ seeds).view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def running(g: np.ndarray, blocks: int) -> np.ndarray:
    """Sums of the signs of the shingles before each position, one row more than there are shingles."""
    out = np.zeros((len(g) + 1, 16 * blocks), np.int32)
    out[1:] = signs(g, blocks)
    return np.add.accumulate(out, axis=0, out=out)


def simhash(g: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of windows, their fingerprints as rows of blocks) of the windows [start, end) of ``g``, in groups.

    Windows must be in order of their starts.  Sums are differences of running sums over one group's shingles.
    """
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + s.group)))
        stop = min(stop, at + s.group)
        low, high = int(starts[at]), int(ends[at:stop].max())
        total = np.zeros((stop - at, 16 * s.blocks), np.int32)
        if stop - at == 1:  # one window, which may be any long
            for a in range(low, high, s.group):
                total[0] += signs(g[a : min(a + s.group, high)], s.blocks).sum(axis=0, dtype=np.int32)
        else:
            a, b = starts[at:stop], ends[at:stop]
            done, before = np.zeros((1, 16 * s.blocks), np.int32), low
            for c in range(low, high, s.group):
                sums = done + running(g[c : min(c + s.group, high)], s.blocks)
                for edge, sign in ((a, -1), (b, 1)):
                    here = np.flatnonzero((edge > before) & (edge <= c + s.group) | (edge == low) & (c == low))
                    total[here] += sign * sums[edge[here] - c]
                done, before = sums[-1:], c + s.group
        yield np.arange(at, stop), np.packbits(total > 0, axis=1).view(np.uint16)
        at = stop


class HammingIndex:
    """Finds the fingerprints of a group that agree with a query on a block at least: all those within ``blocks - 1`` bits.

    One sorted table holds, for each block of each fingerprint, a key of block, group and value.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray) -> None:
        key = self._keys(prints, group)
        self.order = np.argsort(key, axis=None, kind="stable")
        self.keys, self.blocks = key.ravel()[self.order], prints.shape[1]

    @staticmethod
    def _keys(prints: np.ndarray, group: np.ndarray) -> np.ndarray:
        block = np.arange(prints.shape[1], dtype=np.uint64) << np.uint64(16)
        return prints.astype(np.uint64) | block | (group.astype(np.uint64)[:, None] << np.uint64(32))

    def near(self, queries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (query number, fingerprint number) that share a block."""
        key = self._keys(queries, group).ravel()
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        count = high - low
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        q = np.repeat(np.arange(len(key)) // self.blocks, count)
        p = self.order[np.repeat(low, count) + inner] // self.blocks
        pairs = np.unique(q * max(len(self.keys), 1) + p)
        return pairs // max(len(self.keys), 1), pairs % max(len(self.keys), 1)


class ItemIndex:
    def __init__(self, ids: list, texts: list, s: Settings) -> None:
        self.s = s
        g, off, words = shingles(pa.array(texts, pa.large_string()), s.k)
        keep = [i for i in range(len(ids)) if off[i + 1] > off[i]]
        self.ids = [ids[i] for i in keep]
        self.words = words[keep]
        parts = [g[off[i] : off[i + 1]] for i in keep]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.counts = [Counter(p.tolist()) for p in parts]
        joined, end = np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(self.sizes)
        prints = [x for _, x in simhash(joined, end - self.sizes, end, s)]
        self.index = HammingIndex(np.concatenate(prints) if prints else np.zeros((0, s.blocks), np.uint16), self.sizes)
        self.all = np.unique(g)
        self.gate = np.zeros(1 << s.gate_bits, bool)
        self.gate[(self.all >> np.uint64(64 - s.gate_bits)).astype(np.int64)] = True
        self.lengths = np.unique(self.sizes)

    def hits(self, g: np.ndarray) -> np.ndarray:
        """True for the shingles that some item has."""
        out = self.gate[(g >> np.uint64(64 - self.s.gate_bits)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.all, g[at]), max(len(self.all) - 1, 0))
        out[at] = self.all[place] == g[at] if len(self.all) else False
        return out

    def similarity(self, window: np.ndarray, item: int) -> float:
        a, b = Counter(window.tolist()), self.counts[item]
        both = sum(min(n, b[x]) for x, n in a.items() if x in b)
        return both / (len(window) + int(self.sizes[item]) - both)

    def leaks(self, g: np.ndarray, hit: np.ndarray, words: int) -> list[dict]:
        """The items found in one document, given its shingles and which of them some item has."""
        best: dict[int, tuple[float, int, int]] = {}
        upto, share = np.r_[0, np.cumsum(hit)], self.s.threshold / (1 + self.s.threshold)
        windows = []
        for size in self.lengths[self.lengths * self.s.threshold - 1e-9 <= len(g)].tolist():
            span = min(size, len(g))
            # a window can't share more shingles with an item than it has hits
            starts = np.flatnonzero(upto[span:] - upto[: len(upto) - span] >= share * (size + span) - 1e-9)
            if len(starts):
                windows.append((size, span, starts))
        low = min((int(starts[0]) for *_, starts in windows), default=0)
        high = max((int(starts[-1]) + span for _, span, starts in windows), default=0)
        # windows that lie close together share their running sums, whatever their lengths
        sums = running(g[low:high], self.s.blocks) if high - low <= self.s.group else None
        for size, span, starts in windows:
            if sums is None:
                hashed = simhash(g, starts, starts + span, self.s)
            else:
                hashed = [(np.arange(len(starts)), np.packbits(sums[starts + span - low] > sums[starts - low], axis=1).view(np.uint16))]
            for which, prints in hashed:
                for q, item in zip(*(x.tolist() for x in self.index.near(prints, np.full(len(which), size))), strict=True):
                    start = int(starts[which[q]])
                    sim = self.similarity(g[start : start + span], item)
                    if sim >= self.s.threshold and (item not in best or (sim, -start) > (best[item][0], -best[item][1])):
                        best[item] = (sim, start, min(start + span + self.s.k - 1, words))
        return [{"item_id": self.ids[i], "similarity": v[0], "start_word": v[1], "end_word": v[2]} for i, v in sorted(best.items())]


def _blocks(items: DataFrame, s: Settings) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded size; each is collected by itself."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n:
        return
    if n <= s.block_items and chars <= s.block_chars:
        found = rows.orderBy("item_id", "text").collect()
        yield [r.item_id for r in found], [r.text for r in found]
        return
    # neighbours by id; a block has at most block_chars characters and one item more
    before = Window.orderBy("item_id", "text")
    number = F.greatest(F.floor((F.row_number().over(before) - 1) / s.block_items), F.floor(F.sum(F.length("text")).over(before) / s.block_chars))
    rows = durable(rows.withColumn("_b", number))
    for (b,) in rows.select("_b").distinct().orderBy("_b").collect():
        found = rows.where(F.col("_b") == b).orderBy("item_id", "text").collect()
        yield [r.item_id for r in found], [r.text for r in found]


_LEAK = "array<struct<item_id:bigint,similarity:double,start_word:int,end_word:int>>"
_LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())]))


def find_leaks(docs: DataFrame, items: DataFrame, s: Settings | None = None) -> DataFrame:
    """All columns of ``docs`` and ``leaks``, an array of item_id, similarity, start_word, end_word; no shuffle."""
    s = s or Settings()
    names = [c for c in docs.columns if c.lower() != "leaks"]
    out = docs.select(*names).withColumn("leaks", F.array().cast(_LEAK))
    for ids, texts in _blocks(items, s):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(ids, texts, s))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for whole in batches:
                for batch in slices(whole, "_rl_text"):
                    g, off, words = shingles(batch.column("_rl_text"), s.k)
                    hit = index.hits(g)
                    row = np.unique(np.searchsorted(off, np.flatnonzero(hit), "right") - 1)
                    found = {int(r): index.leaks(g[off[r] : off[r + 1]], hit[off[r] : off[r + 1]], int(words[r])) for r in row}
                    leaks = pa.array([found.get(i, []) for i in range(batch.num_rows)], _LEAK_ARROW)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*names, "leaks"]), leaks], names=[*names, "leaks", "_rl_new"])

        kinds = dict(out.dtypes)
        rows = out.withColumn("_rl_text", F.col("text").cast("string"))
        out = rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "leaks"]) + f", _rl_new {_LEAK}")
        out = out.withColumn("leaks", F.concat("leaks", "_rl_new")).drop("_rl_new")
    return out
