"""Byte-level views of text columns, shared by the operators of this package.

The per-row work runs inside ``mapInArrow`` on whole Arrow batches: the texts of
a batch are one byte buffer with row offsets, and words, windows and hashes are
numpy arrays over it.  A batch is cut into slices of a few megabytes, so memory
is bounded by the slice, or by the longest single text where that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remap.session import prepare

SLICE_BYTES = 2 << 20

# A word is a run of digits, lower-case ASCII letters and non-ASCII characters
# (every byte from 0x80 on) after A-Z is lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

_ODD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the runtime settings the operators rely on."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, and of one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = max(first + 1, min(last, rows))
        yield first, last
        first = last


def word_bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words precede each row.

    ``low`` is lower-cased; a word never crosses a row.
    """
    inside = IN_WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = low[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(lengths.max()), _ODD)[within]
    return mix64(np.add.reduceat(letters, first) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words; runs may cross rows."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i, factor in enumerate(powers(n + 1, 0xD6E8FEB86659FD93)[1:]):
        out += words[i : i + count] * factor
    return mix64(out)


def parse(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of rows: first row, end row, word hashes, words before each row."""
    data, offsets = buffers(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1] - offsets[first]
        low = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, at_word = word_bounds(low, at)
        yield first, last, word_hashes(low, starts, ends), at_word


def binary(arrays: list[np.ndarray]) -> pa.Array:
    """A binary column with each array's bytes."""
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def ended_buckets(df: DataFrame, id_col: str, buckets: int) -> tuple[DataFrame, int]:
    """Rows dealt into buckets of ascending ids, each bucket ended by the next one's first rows.

    Adds ``bucket`` and ``ahead``: 1 marks a row that stands in this bucket only to end
    it, so each row's follower is in its own bucket.  The last bucket is ended by the
    rows of the least id.  Null ids come first.  Only the bounds reach the driver: an id
    per bucket, from a quantile sketch.  Also returns the number of buckets.
    """
    shares = [i / buckets for i in range(1, buckets)]
    least, cuts = df.agg(F.min(id_col), F.percentile_approx(id_col, shares or [0.5], 100_000)).first()
    cuts = sorted(set(cuts or ()) - {least}) if shares else []
    bounds = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    rows = df.withColumn("bucket", F.size(F.filter(bounds, lambda c: c <= F.col(id_col)))).withColumn("ahead", F.lit(0))
    if least is not None:
        ends = {least: len(cuts)} | {c: i for i, c in enumerate(cuts)}  # the bucket that each bound ends
        before = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
        first = df.where(F.col(id_col).isin(list(ends)))
        rows = rows.unionByName(first.withColumn("bucket", before[F.col(id_col)]).withColumn("ahead", F.lit(1)))
    return rows, len(cuts) + 1
