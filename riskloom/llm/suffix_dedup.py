"""Suffix-array dedup (operator 10): every byte of a 50-byte string that a document with a smaller doc_id holds too.

1. Anchors.  Of each ``length`` neighbouring bytes, the 20-byte string with the
   smallest hash is an anchor (window minima), so two equal strings of
   ``length`` bytes have an anchor at the same place.  An anchor's context is
   what a string of ``length`` bytes around it can reach.  Copies that one map
   task holds itself are compared byte by byte and settled at once, so a very
   common passage sends on one anchor a task, not one a document.  All others
   go, packed in compressed blocks, to the shard of their hash.
2. Equal contexts.  Within a shard, anchors of one hash with equal contexts
   (64-bit hashes) are the same text: all but those of the smallest doc_id are
   removed.  This folds groups of copies, however large, into one context.
3. Suffix arrays.  Where one anchor has several contexts, their texts are
   fetched and cut to what has to be sorted: strings whose first minimum is the
   anchor (a string has one, however many contexts hold it), and of those the
   ones of which nearly all bytes are in another document's context, too.  What
   is left is split into shards of bounded size.  Each shard gets a suffix
   array by Larsson-Sadakane refinement (ranks of prefixes two or three times
   as long in each pass, over the groups that are not yet sorted) and common
   prefixes by Kasai's rule (each suffix starts from the prefix of the one
   before, less one).  Suffixes that share ``length`` bytes form a run; the
   arrays of the shards of one anchor range are
   merged by binary search of run prefixes, which gives each string its
   smallest doc_id, and all occurrences in larger ones are removed.  An anchor
   with very many contexts is dealt over several tasks; each sends on one row
   for each of its strings and holder of the smallest doc_id, and those are
   merged by string.
4. The spans found meet the texts, grouped in blocks of rows.

Every shard and block is a partition of its own, whose number grows with the
bytes of the table, so a task's share stays the same at any size.  Everything is
exact but for step 2, where two different contexts of one 20-byte string are
taken as equal if their 64-bit hashes are.

Rows are told apart by doc_id and, where an id occurs more than once, a hash of
the text; rows of one doc_id, or of none, are no larger than each other, so they
take nothing from each other.

Cases: null text counts as empty; shorter texts than ``length`` lose nothing;
rows that repeat doc_id and text are cut alike; a null doc_id is the smallest;
ids are integers; an empty table gives an empty result; a text of any length is
read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, shards
from ._text import mix, slices, span_hash, utf8


@dataclass(frozen=True)
class Settings:
    length: int = 50
    gram: int = 20
    block_bytes: int = 8 << 20  # of text, for a shard of anchors or a block of documents
    flush: int = 1 << 20  # anchors that a map task holds before it writes
    array_bytes: int = 1 << 21  # of contexts in one suffix array
    held_bytes: int = 32 << 20  # of text that a map task holds before it writes
    hot: int = 4_096  # contexts of one anchor above which they are dealt over several tasks
    slice_bytes: int = 1 << 18  # of text, for one pass over anchors: its arrays fit a core's cache
    step: int = 5  # strings of one anchor that are looked for together before any suffix array

    @property
    def reach(self) -> int:
        """How far a string of ``length`` bytes around an anchor can begin before it."""
        return self.length - self.gram


NULL_ID = -(1 << 63)

# -- packed rows ------------------------------------------------------------

#: What a packed row holds, all integer columns but the first of ``STRINGS``, which is the string itself.
SPANS, ANCHORS, OPEN, CONTEXTS, STRINGS, TEXTS = range(6)
_SPAN = ["i8", "u8", "i8", "i8"]  # doc, tag, start, end (before clipping)
_ANCHOR = ["u4", "u8", "i8", "u8", "u4"]  # rest of the hash, context hash, doc, tag, place
_OPEN = ["i8", "u8", "u4", "u8", "i4", "u1"]  # doc, tag, place, anchor, part, hot
_CONTEXT = ["u8", "i8", "u8", "u4", "u2", "u2", "u1"]  # anchor, doc, tag, where it begins, bytes, those before the anchor, hot
_HOLDER = ["i8", "u8", "i8"]  # doc, tag, place of a string
_TEXT = ["i8", "u8", "u4"]  # doc, tag, bytes
_ROWS = "kind int, shard int, n long, blob binary, data binary"


@cache
def _codec() -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """Compression and its reverse, set up once a worker: many packed rows are small."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _matrix(columns: list[np.ndarray]) -> np.ndarray:
    """A row of bytes for each entry of the columns."""
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize) for c in columns], axis=1)


def _columns(planes: np.ndarray, kinds: list[str]) -> list[np.ndarray]:
    """The columns whose bytes are the rows of ``planes``."""
    at = np.cumsum([0, *(np.dtype(kind).itemsize for kind in kinds)]).tolist()
    return [np.ascontiguousarray(planes[a:b].T).view(kind).ravel() for a, b, kind in zip(at, at[1:], kinds, strict=False)]


def pack(columns: list[np.ndarray]) -> bytes:
    """Integer columns as compressed byte planes; planes of slowly changing columns nearly vanish."""
    return _codec()[0](_matrix(columns).T.tobytes())


def unpack(blob: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    return _columns(_planes(blob, n, kinds), kinds)


def _planes(blob: bytes, n: int, kinds: list[str]) -> np.ndarray:
    return np.frombuffer(_codec()[1](blob), np.uint8).reshape(sum(np.dtype(kind).itemsize for kind in kinds), n)


def packed_by(kind: int, key: np.ndarray, columns: list[np.ndarray], texts: list[bytes] | None = None) -> list[tuple]:
    """Rows of ``_ROWS``: columns, and byte strings if given, split by an integer key and compressed."""
    order = np.argsort(key, kind="stable")
    key, matrix = key[order], _matrix(columns)[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=False):
        data = None if texts is None else _codec()[0](b"".join(texts[i] for i in order[a:b].tolist()))
        out.append((kind, int(key[a]), b - a, _codec()[0](matrix[a:b].T.tobytes()), data))
    return out


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["kind", "shard", "n", "blob", "data"])


def unpack_all(rows: list[tuple], kind: int, kinds: list[str]) -> list[np.ndarray]:
    parts = [_planes(blob, n, kinds) for k, _, n, blob, _ in rows if k == kind]
    return _columns(np.concatenate(parts, axis=1), kinds) if parts else [np.zeros(0, k) for k in kinds]


def unpack_texts(rows: list[tuple], kind: int, kinds: list[str], size: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Columns and byte strings; column ``size`` has the lengths."""
    columns = unpack_all(rows, kind, kinds)
    texts, sizes, first = [], columns[size].tolist(), 0
    for k, _, n, _, data in rows:
        if k == kind:
            whole, at = _codec()[1](data), 0
            for m in sizes[first : first + n]:
                texts.append(whole[at : at + m])
                at += m
            first += n
    return columns, texts


def in_shards(rows: DataFrame, n: int, f: Callable[[list[tuple]], pa.RecordBatch], schema: str = _ROWS) -> DataFrame:
    """``f`` of all packed rows of each shard, which is a partition by itself: no two of them share a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if held:
            yield f(held)

    return rows.repartitionById(n, "shard").mapInArrow(run, schema)


# -- anchors ----------------------------------------------------------------


def _extreme(a: np.ndarray, width: int, f) -> np.ndarray:
    """Running minimum or maximum of each ``width`` neighbours, by doubling."""
    have, out = 1, a
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def _hashes(data: np.ndarray, s: Settings) -> np.ndarray:
    """Hash, at least 1, of the string of ``gram`` bytes at each place."""
    word = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h, count = np.zeros(len(data) - s.gram + 1, np.uint64), len(data) - s.gram + 1
    for i, at in enumerate([*range(0, s.gram - 8, 8), s.gram - 8]):
        part = word[at : at + count] * np.uint64((0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF | 1)
        h ^= part ^ (part >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(h ^ (h >> np.uint64(31)), np.uint64(1))


def anchors(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in the bytes of a slice, and their hashes."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < s.length:
        return none, none.astype(np.uint64)
    h = _hashes(data, s)
    window = s.reach + 1
    low = _extreme(h, window, np.minimum)
    # windows of s.length bytes must lie within one row
    valid = np.zeros(len(low), bool)
    row_len = np.diff(offsets)
    for a, b in zip(offsets[:-1][row_len >= s.length], offsets[1:][row_len >= s.length] - s.length + 1, strict=True):
        valid[a:b] = True
    low = np.where(valid, low, np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    top = _extreme(padded, window, np.maximum)[: len(h)]
    at = np.flatnonzero((top == h) & (h > 0))
    return at, mix(h[at] + np.uint64(1))  # minima are small; mixed again, they fill the shards evenly


#: Masks of the first 0 to 8 bytes of a little-endian word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _block_of(doc: np.ndarray, tag: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(doc.view(np.uint64) ^ mix(tag)) % np.uint64(blocks)).astype(np.int32)


def copies(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, h: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for anchors whose context is, byte by byte, that of an anchor of a smaller doc_id among those given."""
    out = np.zeros(len(h), bool)
    key = mix(h ^ mix(ctx))
    order = np.argsort(key)
    key = key[order]
    again = np.r_[False, key[1:] == key[:-1], False]
    order = order[again[1:] | again[:-1]] if len(h) else order  # keys that occur more than once
    order = order[np.lexsort((doc[order], ctx[order], h[order]))]
    hs, cs, ds = h[order], ctx[order], doc[order]
    first = np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])] if len(order) else np.zeros(0, bool)
    least = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = np.flatnonzero(ds > ds[least])
    if not len(later):
        return out
    a, b = order[later], order[least[later]]
    alike = (end[a] - begin[a] == end[b] - begin[b]) & (at[a] - begin[a] == at[b] - begin[b])
    a, b = a[alike], b[alike]
    size, same = end[a] - begin[a], np.ones(len(a), bool)
    word = np.ndarray((len(data) + 1,), "<u8", data.tobytes() + bytes(8), strides=(1,))  # eight bytes from each place
    for i in range(0, int(size.max(initial=0)), 8):
        here, there = np.minimum(begin[a] + i, len(data)), np.minimum(begin[b] + i, len(data))
        same &= (word[here] ^ word[there]) & _LOW[np.clip(size - i, 0, 8)] == 0
    out[a[same]] = True
    return out


def _anchor_rows(docs: DataFrame, s: Settings, n: int) -> DataFrame:
    """Packed anchors by shard, and spans that are settled already by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0

        def flush():
            data, begin, end, place, h, ctx, doc, tag, at = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            known = copies(data, begin, end, place, h, ctx, doc)
            local = at[known].astype(np.int64)
            spans = _merged(doc[known], tag[known], np.maximum(local - s.reach, 0), local + s.length)
            rest = ~known
            shard = (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)
            columns = [(h & np.uint64(0xFFFFFFFF)).astype(np.uint32), ctx, doc, tag, at]
            return rows_of(packed_by(SPANS, _block_of(spans[0], spans[1], n), spans) + packed_by(ANCHORS, shard[rest], [c[rest] for c in columns]))

        for whole in batches:
            for batch in slices(whole, "text", s.slice_bytes):
                data, off = utf8(batch.column("text"))
                at, h = anchors(data, off, s)
                row = np.searchsorted(off, at, "right") - 1
                begin, end = np.maximum(at - s.reach, off[row]), np.minimum(at + s.length, off[row + 1])
                ctx = mix(span_hash(data, begin, at) * np.uint64(3) + span_hash(data, at, end))
                doc, tag = np.asarray(batch.column("id"))[row], np.asarray(batch.column("tag")).view(np.uint64)[row]
                held.append((data, begin + base, end + base, at + base, h, ctx, doc, tag, (at - off[row]).astype(np.uint32)))
                base += len(data)
                size += len(at)
                if size >= s.flush:
                    yield flush()
                    size = base = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _ROWS)


def settle(h: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(settled, open): indices of anchors whose context a smaller doc_id has, and of those to be looked at as text."""
    order = np.argsort(h)
    again = np.r_[False, h[order[1:]] == h[order[:-1]], False]
    order = order[again[1:] | again[:-1]] if len(h) else order  # hashes that occur more than once
    order = order[np.lexsort((doc[order], ctx[order], h[order]))]
    if not len(order):
        return order, order
    hs, cs, ds = h[order], ctx[order], doc[order]
    new_h = np.r_[True, hs[1:] != hs[:-1]]
    new_c = new_h | np.r_[True, cs[1:] != cs[:-1]]
    g_h, g_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
    least = ds[new_c][g_c]  # sorted by doc within a context
    settled = ds > least
    contexts = np.bincount(g_h, new_c)
    starts = np.flatnonzero(new_h)
    many_docs = np.minimum.reduceat(ds, starts) != np.maximum.reduceat(ds, starts)
    return order[settled], order[~settled & ((contexts > 1) & many_docs)[g_h]]


def first_minima(text: np.ndarray, begin: np.ndarray, at: np.ndarray, end: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """How far before its anchor at least and at most a string begins that has its first minimum there; none if least > most.

    A string has one first minimum wherever it stands, so it need not be looked at in the contexts of its other anchors.
    """
    most, behind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    if len(at):
        h = _hashes(text, s)
        own = h[at]
        free, clear = np.ones(len(at), bool), np.ones(len(at), bool)
        for i in range(1, s.reach + 1):
            free &= (at - i >= begin) & (h[np.maximum(at - i, 0)] > own)
            clear &= (at + i + s.gram <= end) & (h[np.minimum(at + i, len(h) - 1)] >= own)
            most += free
            behind += clear
    return s.reach - behind, most


def shared(text: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, doc: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``least`` and ``most`` narrowed to strings that another document can hold: all that one holds, and few others.

    A string has its anchor at one place wherever it stands.  What ``step`` neighbouring strings around
    an anchor have in common is shared, too, where one of them is; equal hashes only keep more.
    """
    low, high = np.full(len(at), s.length), np.full(len(at), -1)
    for begin in range(0, s.reach + 1, s.step):
        last = min(begin + s.step - 1, s.reach)
        has = np.flatnonzero((least <= last) & (most >= begin) & (least <= most))
        if len(has):
            key = span_hash(text, at[has] - begin, at[has] + s.length - last)
            order = np.argsort(key)
            has, key = has[order], key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            starts = np.flatnonzero(first)
            several = np.minimum.reduceat(doc[has], starts) != np.maximum.reduceat(doc[has], starts)
            has = has[several[np.cumsum(first) - 1]]
            low[has], high[has] = np.minimum(low[has], begin), np.maximum(high[has], last)
    return np.maximum(least, low), np.minimum(most, high)


# -- suffix arrays ----------------------------------------------------------


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes of the texts that end before ``ends`` in order: Larsson-Sadakane refinement.

    Starts from ranks of 8-byte prefixes; every pass sorts each group that is
    still tied by the ranks of the suffixes ``h`` and, if three ranks fit 64
    bits, ``2 * h`` bytes on, then ``h`` is as many times larger.
    At ``ends`` stand terminators, each unlike any other and above all bytes, so
    no comparison runs on into another text.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    key = np.ndarray((n,), ">u8", np.concatenate([text, np.array([255] + [0] * 7, np.uint8)]).tobytes(), strides=(1,)).astype(np.uint64)
    stop = np.repeat(ends, np.diff(np.r_[-1, ends]))[:n]  # the terminator of each place; one at n is only thought of
    left = stop - np.arange(n)
    short = np.flatnonzero(left < 7)  # what lies behind a terminator doesn't count
    key[short] &= ~np.uint64(0) << ((np.uint64(7) - left[short].astype(np.uint64)) * np.uint64(8))
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.uint64)
    rank[order], rank[n] = start, n
    ends = ends[ends < n]
    last = n - len(ends)  # terminators come last, in the order of their places
    if len(ends):
        order[last:], rank[ends] = ends, np.arange(last, n)
        first[last:] = True
    h, times, base = 8, 3 if (n + 1) ** 3 <= 1 << 64 else 2, np.uint64(n + 1)
    while True:
        tied = ~(first & np.r_[first[1:], True])
        place = np.flatnonzero(tied)  # places in groups of two or more
        if not len(place):
            return order
        who = order[place]
        key, until = rank[who], stop[who]
        for k in range(1, times):
            key = key * base + rank[np.minimum(who + k * h, until)]
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[place] = who
        split = np.r_[True, key[1:] != key[:-1]]
        first[place] = split
        rank[who] = place[np.maximum.accumulate(np.where(split, np.arange(len(place)), 0))]
        h *= times


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``limit`` bytes (Kasai's rule).

    The texts [start, end) are walked side by side, all suffixes at one distance from their starts at a time.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.empty(n, np.int64)  # the suffix before each, by text place
    before[order[1:]] = order[:-1]
    if n:
        before[order[0]] = -1
    left = np.zeros(n + 1, np.int64)  # bytes up to the end of the text that a place lies in
    size = ends - starts
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    left[np.repeat(starts, size) + inner] = np.repeat(size, size) - inner
    have = np.zeros(len(starts), np.int64)
    for d in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > d)
        i = starts[live] + d
        j = before[i]
        most = np.where(j >= 0, np.minimum(np.minimum(left[i], left[j]), limit), 0)
        length = np.minimum(np.maximum(have[live] - 1, 0), most)
        going = np.flatnonzero(length < most)
        while len(going):
            k = length[going]
            going = going[text[i[going] + k] == text[j[going] + k]]
            length[going] += 1
            going = going[length[going] < most[going]]
        have[live] = length
        out[place[i]] = length
    return out


def _sortable(strings: np.ndarray, length: int) -> np.ndarray:
    """Byte strings that numpy sorts; one is added to each byte (0xFF does not occur), since it ignores zeros at the end."""
    return (np.ascontiguousarray(strings).view(np.uint8).reshape(-1, length) + np.uint8(1)).view(f"S{length}").ravel() if len(strings) else np.zeros(0, f"S{length}")


def _shard_of(strings: np.ndarray, s: Settings, n_shards: int) -> np.ndarray:
    at = np.arange(len(strings)) * s.length
    data = np.ascontiguousarray(strings).view(np.uint8) if len(strings) else np.zeros(0, np.uint8)
    return (span_hash(data, at, at + s.length) % np.uint64(n_shards)).astype(np.int32)


class Shard:
    """A suffix array over some contexts: sorted runs of equal ``length``-byte strings."""

    def __init__(self, blobs: list[bytes], doc: np.ndarray, base: np.ndarray, s: Settings) -> None:
        """``base``: where each context begins in its document."""
        self.s, self.doc = s, doc
        size = np.array([len(b) for b in blobs], np.int64)
        # 0xFF is no byte of UTF-8, so no string of a context runs over its end
        text = np.frombuffer(b"\xff".join(blobs), np.uint8) if blobs else np.zeros(0, np.uint8)
        self.starts = np.r_[0, np.cumsum(size + 1)[:-1]] if len(size) else np.zeros(0, np.int64)
        ends = self.starts + size
        order = suffix_array(text, ends)
        lcp = common_prefixes(text, order, self.starts, ends, s.length)
        owner = np.repeat(np.arange(len(size)), size + 1)[order]
        whole = order + s.length <= ends[owner]
        # what lies between two whole suffixes of a run shares its bytes, so it is whole too
        run = np.cumsum(lcp < s.length) - 1
        order, owner, run = order[whole], owner[whole], run[whole]
        self.owner, self.at = owner, order - self.starts[owner] + base[owner]
        first = np.r_[True, run[1:] != run[:-1]] if len(order) else np.zeros(0, bool)
        self.run = np.cumsum(first) - 1
        heads = order[first]
        window = np.lib.stride_tricks.sliding_window_view(text, s.length)[heads] if len(heads) else np.zeros((0, s.length), np.uint8)
        self.strings = np.ascontiguousarray(window).view(f"V{s.length}").ravel()
        self.least = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.run, doc[owner])

    def keys(self) -> np.ndarray:
        return _sortable(self.strings, self.s.length)

    def first_holders(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, context, place) of every string in the documents with the smallest doc_id."""
        first = self.doc[self.owner] == self.least[self.run]
        return self.strings[self.run[first]], self.owner[first], self.at[first]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(context, place) of every string that a smaller doc_id has."""
        later = self.doc[self.owner] > self.least[self.run]
        return self.owner[later], self.at[later]


def merge(all_shards: list[Shard]) -> None:
    """Gives every run the smallest doc_id of any shard: each looks its strings up in the others' sorted ones."""
    keys = [x.keys() for x in all_shards]
    best = [x.least.copy() for x in all_shards]
    for a, x in enumerate(all_shards):
        for b, y in enumerate(all_shards):
            if a != b and len(keys[a]) and len(keys[b]):
                to = np.minimum(np.searchsorted(keys[b], keys[a]), len(keys[b]) - 1)
                same = keys[b][to] == keys[a]
                best[a][same] = np.minimum(best[a][same], y.least[to[same]])
    for x, least in zip(all_shards, best, strict=True):
        x.least = least

# -- the operator -----------------------------------------------------------


def _merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of one row that touch or overlap, joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    if not len(doc):
        return [doc, tag, start, end]
    same = np.r_[False, (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])]
    group = np.cumsum(~same)
    # a running maximum of ends within a row: rows are kept apart by an offset
    wide = np.int64(1) << np.int64(34)
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = np.r_[True, ~same[1:] | (start[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return [doc[at], tag[at], start[at], np.maximum.reduceat(end, at)]


def _packed_texts(docs: DataFrame, s: Settings, n: int) -> DataFrame:
    """The documents (id, tag, text) packed by block: compressed, they take less room in a shuffle than as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, tag = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64).view(np.uint64)
            texts = [r[2] for r in held]
            held.clear()
            return rows_of(packed_by(TEXTS, _block_of(doc, tag, n), [doc, tag, np.array([len(x) for x in texts], np.uint32)], texts))

        for batch in batches:
            for d, t, x in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
                held.append((d, t, x.as_py().encode()))
                size += len(held[-1][2])
                if size >= s.held_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _ROWS)


def repeated_spans(docs: DataFrame, texts: DataFrame, s: Settings, n: int) -> DataFrame:
    """Packed spans (doc, tag, start, end) by block of rows; ``docs`` has id, tag, text, ``texts`` the same packed."""

    def look(rows: list[tuple]) -> pa.RecordBatch:
        shard = rows[0][1]
        h, ctx, doc, tag, at = unpack_all(rows, ANCHORS, _ANCHOR)
        settled, left = settle(h, ctx, doc)
        place = at.astype(np.int64)
        spans = _merged(doc[settled], tag[settled], np.maximum(place[settled] - s.reach, 0), place[settled] + s.length)
        anchor = (np.uint64(shard) << np.uint64(32)) | h[left].astype(np.uint64)
        # all contexts of an anchor go to one part, but those of an anchor with very many are dealt by document
        _, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
        count = count[which]
        hot = count > s.hot
        salt = np.where(hot, mix(doc[left].view(np.uint64) ^ mix(tag[left])) % (count // s.hot + 1).astype(np.uint64), 0).astype(np.uint64)
        part = (mix(anchor + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int32)
        done = packed_by(SPANS, _block_of(spans[0], spans[1], n), spans)
        open_ = packed_by(OPEN, _block_of(doc[left], tag[left], n), [doc[left], tag[left], at[left], anchor, part, hot.astype(np.uint8)])
        return rows_of([r for r in rows if r[0] == SPANS] + done + open_)

    found = durable(in_shards(_anchor_rows(docs, s, n), n, look))

    def fetch(rows: list[tuple]) -> pa.RecordBatch:
        doc, tag, at, anchor, part, hot = unpack_all(rows, OPEN, _OPEN)
        if not len(doc):
            return rows_of([])
        (ids, tags, _), held = unpack_texts(rows, TEXTS, _TEXT, 2)
        where = dict(zip(zip(ids.tolist(), tags.tolist(), strict=True), held, strict=True))  # rows of one id and tag are equal
        at = at.astype(np.int64)
        begin = np.maximum(at - s.reach, 0)
        pieces = [where[k][a : b + s.length] for k, a, b in zip(zip(doc.tolist(), tag.tolist(), strict=True), begin.tolist(), at.tolist(), strict=True)]
        size = np.array([len(x) for x in pieces], np.uint16)
        return rows_of(packed_by(CONTEXTS, part, [anchor, doc, tag, begin.astype(np.uint32), size, (at - begin).astype(np.uint16), hot], pieces))

    contexts = in_shards(texts.unionByName(found.where(F.col("kind") == OPEN)), n, fetch)

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        (anchor, doc, tag, base, size, before, hot), blobs = unpack_texts(rows, CONTEXTS, _CONTEXT, 4)
        end = np.cumsum(size.astype(np.int64))
        begin, text = end - size, b"".join(blobs)
        place, data = begin + before, np.frombuffer(text, np.uint8)
        least, most = first_minima(data, begin, place, end, s)
        low, high = shared(data, place, least, most, doc, s)
        # strings of a hot anchor can be in other tasks
        least, most = np.where(hot > 0, least, low), np.where(hot > 0, most, high)
        live = np.flatnonzero(least <= most)
        order = live[np.lexsort((anchor[live], hot[live]))]
        blobs = [text[a:b] for a, b in zip((place - most)[order].tolist(), (place - least + s.length)[order].tolist(), strict=True)]
        base = base.astype(np.int64) + before - most
        anchor, doc, tag, base, hot = (c[order] for c in (anchor, doc, tag, base, hot))
        size = np.cumsum([len(b) for b in blobs])
        cold = int(np.searchsorted(hot, 1))  # contexts of hot anchors come last
        spans, open_ = [], []
        begin = 0
        while begin < len(blobs):
            # as many whole anchors as an array holds; a larger anchor gets several arrays, merged by binary search
            limit = cold if begin < cold else len(blobs)
            end = int(np.searchsorted(size[:limit], (size[begin - 1] if begin else 0) + s.array_bytes))
            end = max(begin + 1, min(end, limit))
            if end < limit and anchor[end] == anchor[end - 1]:
                low, high = np.searchsorted(anchor[begin:limit], anchor[end], "left"), np.searchsorted(anchor[begin:limit], anchor[end], "right")
                end = begin + int(low if low else high)
            cuts, at = [], begin
            while at < end:
                stop = max(at + 1, min(int(np.searchsorted(size, (size[at - 1] if at else 0) + s.array_bytes)), end))
                cuts.append((at, stop))
                at = stop
            arrays = [Shard(blobs[a:b], doc[a:b], base[a:b], s) for a, b in cuts]
            merge(arrays)
            for (a, _), x in zip(cuts, arrays, strict=True):
                owner, place = x.spans()
                spans.append(_merged(doc[owner + a], tag[owner + a], place, place + s.length))
                if begin >= cold:
                    string, owner, place = x.first_holders()
                    open_.append((string, doc[owner + a], tag[owner + a], place))
            begin = end
        columns = _merged(*(np.concatenate(c) for c in zip(*spans, strict=True))) if spans else [np.zeros(0, k) for k in _SPAN]
        left = [np.concatenate(c) for c in zip(*open_, strict=True)] if open_ else [np.zeros(0, f"V{s.length}"), *(np.zeros(0, k) for k in _HOLDER)]
        return rows_of(packed_by(SPANS, _block_of(columns[0], columns[1], n), columns) + packed_by(STRINGS, _shard_of(left[0], s, n), left))

    def meet(rows: list[tuple]) -> pa.RecordBatch:
        string, doc, tag, place = unpack_all(rows, STRINGS, [f"V{s.length}", *_HOLDER])
        key = _sortable(string, s.length)
        order = np.lexsort((doc, key))
        key, doc, tag, place = key[order], doc[order], tag[order], place[order]
        first = np.r_[True, key[1:] != key[:-1]]
        late = doc > doc[first][np.cumsum(first) - 1]  # sorted by doc within a string
        spans = _merged(doc[late], tag[late], place[late], place[late] + s.length)
        return rows_of(packed_by(SPANS, _block_of(spans[0], spans[1], n), spans))

    sorted_ = durable(in_shards(contexts, n, sort))
    # strings of hot anchors, from all the tasks that they were dealt over
    late = in_shards(sorted_.where(F.col("kind") == STRINGS), n, meet)
    return found.unionByName(sorted_).where(F.col("kind") == SPANS).unionByName(late)


def suffix_dedup(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of start, end), kept (binary), one row for each row of ``docs``."""
    s = s or Settings()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # only where an id occurs twice do rows need more than their id
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()
    rows = rows.select("id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("tag"), "text")
    n = shards(rows, s.block_bytes, total)
    texts = _packed_texts(rows, s, n)
    spans = repeated_spans(rows, texts, s, n)

    def finish(packed: list[tuple]) -> pa.RecordBatch:
        where: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, t, a, b in zip(*(c.tolist() for c in _merged(*unpack_all(packed, SPANS, _SPAN))), strict=True):
            where.setdefault((d, t), []).append((a, b))
        out = []
        (ids, tags, _), held = unpack_texts(packed, TEXTS, _TEXT, 2)
        for d, t, data in zip(ids.tolist(), tags.tolist(), held, strict=True):
            parts, cut, at = [], [], 0
            for a, b in where.get((d, t), ()):
                a, b = min(a, len(data)), min(b, len(data))
                if b > a:
                    parts.append(data[at:a])
                    cut.append({"start": a, "end": b})
                    at = b
            parts.append(data[at:])
            kept = b"".join(parts)
            out.append((None if d == NULL_ID else d, len(data), len(data) - len(kept), len(cut), cut, kept))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return in_shards(texts.unionByName(spans), n, finish, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
