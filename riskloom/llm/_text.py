"""Vectorised text primitives shared by the Arrow-based operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so one
numpy pass handles all documents of a slice and no per-row Python objects are
made.  Slices are bounded by bytes, not rows: a very long document is a slice
of its own and is still read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of the contracts: maximal runs of anything but space, tab, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240131)
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
#: 0 white space, 1 letters, digits and all non-ASCII bytes, 2 other ASCII.
BYTE_CLASS = np.array([0 if not IS_WORD[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 2)
        for i, base in enumerate((_MULT, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (xor-shift-multiply), so that all bits vary."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    _, offsets = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the n+1 row offsets in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``member`` bytes, which never cross rows.

    ``cut`` (optional, one value a byte) ends a run wherever it changes.
    """
    n = len(member)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~member[:-1] if cut is None else ~member[:-1] | (cut[1:] != cut[:-1])
    inner = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
    first[inner] = True
    starts = np.flatnonzero(first & member)
    # a run ends where the next run or a non-member begins
    stop = np.flatnonzero(first | ~member)
    nxt = np.searchsorted(stop, starts, "right")
    ends = np.where(nxt < len(stop), stop[np.minimum(nxt, len(stop) - 1)], n)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for every span, position independent."""
    power, inverse = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every contract word, in text order."""
    starts, ends, row = runs(IS_WORD[data], offsets)
    return span_hash(data, starts, ends), row


def gram_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all k-grams of consecutive words of one row."""
    if len(h) < k:
        return h[:0], row[:0]
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    keep = row[: len(out)] == row[k - 1 :]
    return mix(out[keep]), row[: len(out)][keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word-shingle hashes of every row: values sorted by row then value, and n+1 offsets.

    A row of fewer than ``k`` words (but at least one) has one shingle, of all its words.
    """
    n = len(offsets) - 1
    h, row = word_hashes(data, offsets)
    g, g_row = gram_hashes(h, row, k)
    count = np.bincount(row, minlength=n)
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        if len(short):
            pick = np.isin(row, short)
            sg, sr = gram_hashes(h[pick], row[pick], size)
            g, g_row = np.concatenate([g, sg]), np.concatenate([g_row, sr])
    order = np.lexsort((g, g_row))
    g, g_row = g[order], g_row[order]
    if len(g):
        keep = np.r_[True, (g[1:] != g[:-1]) | (g_row[1:] != g_row[:-1])]
        g, g_row = g[keep], g_row[keep]
    return g, np.searchsorted(g_row, np.arange(n + 1))
