"""Quality rules (operator 7): compression bands.

A whole document and its fixed-size chunks are compressed with zstandard.  Text
whose ratio (bytes in / bytes out) lies above the upper limit of its length
band is repetitive, below the lower limit incompressible; either is rejected.
Ratios grow with length, since a longer text has more to refer back to, so
limits are given per band of byte lengths.  Chunks of one size need one band
only; the last one is aligned to the end of the text, so that no byte of a text
longer than a chunk is left out, and shorter texts are judged as a whole.  A
document fails by chunks when more than ``chunk_share`` of them do.

Cases: null text counts as empty; empty text has ratio 0 and fails by
``n_words < min_words``; one of any length is read whole; repeated rows are
judged each by itself; a null doc_id is judged; an empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(from bytes, lowest ratio, highest ratio) for whole documents, ascending; and one band for chunks."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 5.0),
        (200, 0.9, 2.4),
        (500, 1.1, 2.4),
        (1_000, 1.2, 2.5),
        (4_000, 1.3, 2.7),
        (16_000, 1.4, 3.0),
        (64_000, 1.4, 3.6),
    )
    chunk_bytes: int = 4_096
    chunk: tuple[float, float] = (1.3, 2.8)
    chunk_share: float = 0.2
    level: int = 3
    min_words: int = 50
    max_repeat_pct: int = 50


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, whole_ratio double, bad_chunks long, n_chunks long, reason string"
)


def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if len(words) < size + 1:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


def judge(data: bytes, chars: int, bands: Bands, compress) -> tuple:
    """The row of ``SCHEMA`` for one text given as UTF-8, of ``chars`` code points."""
    words = data.split()  # bytes.split() splits at exactly the six contract spaces
    n = len(words)
    word_bytes = sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_window_words(words)
    failed = n < bands.min_words or 100 * repeats > bands.max_repeat_pct * n
    ratio = len(data) / len(compress(data)) if data else 0.0
    _, low, high = next(b for b in reversed(bands.whole) if len(data) >= b[0])
    bad = chunks = 0
    if len(data) > bands.chunk_bytes:
        last = len(data) - bands.chunk_bytes
        for at in [*range(0, last, bands.chunk_bytes), last]:
            piece = data[at : at + bands.chunk_bytes]
            chunks += 1
            bad += not bands.chunk[0] <= len(piece) / len(compress(piece)) <= bands.chunk[1]
    reason = (
        "base" if failed
        else "repetitive" if ratio > high
        else "incompressible" if ratio < low
        else "chunks" if chunks and bad > bands.chunk_share * chunks
        else None
    )
    return (
        n, chars - (len(data) - word_bytes), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeats, failed, reason is None, ratio, bad, chunks, reason,
    )


def quality_rules(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """doc_id plus the columns of ``SCHEMA``, one row for each row of ``docs``; no shuffle."""
    bands = bands or Bands()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}"
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            rows = [judge((t or "").encode(), len(t or ""), bands, compress) for t in map(pa.StringScalar.as_py, batch.column("text"))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
