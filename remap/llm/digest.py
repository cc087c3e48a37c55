"""Similarity digests from improbable features.

Every window of bytes has an entropy; how often an entropy occurs over all texts gives
its rank, the rarest first.  In each run of neighbouring windows the one of the best
rank scores a point, and windows with enough points are a text's features.  Features go
into Bloom filters, a new one being chained on when one is full.  Two digests are alike
in the share of filter bits they have in common beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.llm.texts import buffers, ended_buckets, mix64, slices

WIDTH = 16  # bytes in a window, and windows in a run
POINTS = 4  # a feature has won at least so many runs
LEAST_BITS = 2.0  # windows of less entropy rank last: they are common to unrelated texts
FILTER_BITS = 2048
FILTER_FEATURES = 128
HASHES = 5
_BINS = 256
_SLICE = 1 << 20

# count * log2(count), scaled to whole numbers so that sums are exact
_XLOGX = np.array([0] + [round(c * np.log2(c) * 65536) for c in range(1, WIDTH + 1)], dtype=np.int64)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Entropy of every window of ``data``, as one of 256 steps between none and log2(WIDTH)."""
    n = len(data)
    before = np.zeros(n, dtype=np.uint8)  # equal bytes among the WIDTH - 1 before, and after
    after = np.zeros(n, dtype=np.uint8)
    for d in range(1, min(WIDTH, n)):
        same = data[d:] == data[:-d]
        before[d:] += same
        after[:-d] += same
    total = np.zeros(n - WIDTH + 1, dtype=np.int64)
    total[0] = _XLOGX[np.bincount(data[:WIDTH], minlength=256)].sum()
    # Moving on by one byte drops the first byte and takes one in.
    drop, take = after[: n - WIDTH], before[WIDTH:]
    total[1:] = (_XLOGX[drop] - _XLOGX[drop + 1] + _XLOGX[take + 1] - _XLOGX[take])
    np.cumsum(total, out=total)
    full = int(_XLOGX[WIDTH])
    return ((full - total) * (_BINS - 1) // full).astype(np.int64)


def _layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, short ones filled with zeros to one window; an empty text stays empty."""
    lengths = np.diff(offsets)
    room = np.where((lengths > 0) & (lengths < WIDTH), WIDTH, lengths)
    if (room == lengths).all():
        return data, offsets
    at = np.concatenate(([0], np.cumsum(room)))
    out = np.zeros(at[-1], dtype=np.uint8)
    out[np.repeat(at[:-1] - offsets[:-1], lengths) + np.arange(len(data))] = data
    return out, at


def window_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows have each entropy."""
    data, at = _layout(data, offsets)
    if len(data) < WIDTH:
        return np.zeros(_BINS, dtype=np.int64)
    return np.bincount(entropy_bins(data)[_inside(at, len(data))], minlength=_BINS)


def _inside(at: np.ndarray, size: int) -> np.ndarray:
    """Window starts that do not run into the next text."""
    good = np.ones(size - WIDTH + 1, dtype=bool)
    for end in at[1:-1]:
        good[max(0, end - WIDTH + 1) : end] = False
    return good


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """Feature hashes of each text, in order of place, each once."""
    none = np.zeros(0, dtype=np.uint64)
    data, at = _layout(data, offsets)
    if len(data) < WIDTH:
        return [none] * (len(at) - 1)
    good = _inside(at, len(data))
    places = len(good)
    # Smallest key wins a run: rank first, then place.  Windows across texts never win.
    key = ranks[entropy_bins(data)] * (1 << 40) + np.arange(places)
    key[~good] = 1 << 60
    best = np.concatenate((key, np.full(WIDTH, 1 << 60)))
    step = 1
    while step < WIDTH:  # the least of a run of 2, 4, .. WIDTH windows
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    winner = best[:places][good] & ((1 << 40) - 1)
    points = np.bincount(winner, minlength=places)
    picked = points >= POINTS
    filled = np.flatnonzero(np.diff(at))
    if len(filled):  # a text always has its best window
        top = points * (1 << 40) + np.arange(places)[::-1]
        peak = np.maximum.reduceat(np.append(top, np.zeros(WIDTH, np.int64)), at[filled])
        picked[places - 1 - (peak & ((1 << 40) - 1))] = True
    chosen = np.flatnonzero(picked)
    words = data[chosen[:, None] + np.arange(WIDTH)].view(np.uint64)
    hashes = np.zeros(len(chosen), dtype=np.uint64)
    for column in words.T:
        hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + column)
    cuts = np.searchsorted(chosen, at)
    out = []
    for a, z in zip(cuts, cuts[1:]):
        _, first = np.unique(hashes[a:z], return_index=True)
        out.append(hashes[a:z][np.sort(first)])
    return out


def filters(found: np.ndarray) -> np.ndarray:
    """Chained Bloom filters of a text's features: one row of bytes per filter."""
    count = -(-len(found) // FILTER_FEATURES)
    bits = np.zeros((count, FILTER_BITS), dtype=bool)
    row = np.arange(len(found)) // FILTER_FEATURES
    for i in range(HASHES):  # eleven bits of the hash each
        bits[row, ((found >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two digests, 0 to 1; 1 for equal ones.

    Each filter of the digest with fewer filters counts with its best match in the
    other.  Common bits count from 0.3 of the way between what chance gives and the
    most there can be, so that unrelated texts get 0.
    """
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    common = x @ y.T
    m, n = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance, most = m * n / FILTER_BITS, np.minimum(m, n)
    floor = chance + 0.3 * (most - chance)
    score = np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1)
    weights = x.sum(axis=1)
    return float((score.max(axis=1) * weights).sum() / weights.sum())


def as_text(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def from_text(digest: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def fit_ranks(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy step, the rarest over all rows first; low entropies come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BINS, dtype=np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, z in slices(offsets, _SLICE):
                total += window_counts(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BINS)), pa.array(total)], ["bin", "n"])

    counted = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bin long, n long")
    seen = np.zeros(_BINS, dtype=np.int64)
    for step, n in counted.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[step] = n  # 256 rows
    low = np.arange(_BINS) < LEAST_BITS / np.log2(WIDTH) * (_BINS - 1)
    ranks = np.zeros(_BINS, dtype=np.int64)
    ranks[np.lexsort((-np.arange(_BINS), seen, low))] = np.arange(_BINS)
    return ranks


def digests(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """Digest of each text."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = []
    for a, z in slices(offsets, _SLICE):
        out += [filters(x) for x in features(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], ranks)]
    return out


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of each row; null is the empty text, whose digest is empty.

    Equal texts of one table have equal digests, wherever they stand.
    """
    ranks = fit_ranks(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = digests([t or "" for t in batch.column(1).to_pylist()], ranks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(as_text, found), pa.string())], ["id", "fingerprint"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` (rounded down) replaced by as much of the start of ``following``."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text and of its edited text, and how alike they and the next text's are.

    Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The next row is that of the next greater id (of rows with
    one id, by text); the last is followed by the first.  Null ids come before all and
    are not returned to at the end.  A null text is empty, has an empty digest, and is
    like an empty text only.  One row alone is followed by itself; where no row has an
    id, the last is followed by an empty text.
    """
    spark = df.sparkSession
    ranks = fit_ranks(df, text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    bucketed, buckets = ended_buckets(rows, "id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = bucketed.repartitionById(buckets, F.col("bucket").cast("int"))
    ordered = spread.sortWithinPartitions("bucket", "ahead", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows still without the next one: the last of the batch before
        for batch in batches:
            ids, texts, ahead = (batch.column(k).to_pylist() for k in (0, 1, 3))
            stop = bisect_right(ahead, 0)
            use = min(len(ids), stop + 1)  # of the rows that end the bucket, only the first
            if held and held[-1] is None:
                continue
            new = list(zip(ids[:use], texts[:use], digests(texts[:use], ranks)))
            chain = held + new
            if len(chain) > 1:
                yield _pairs(chain, ranks, batch.schema.field(0).type)
            held = [None] if use > stop else chain[-1:]
        if held and held[-1] is not None:
            end = ("", digests([""], ranks)[0])
            yield _pairs([held[-1], (None, *end)], ranks, pa.int64())

    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _pairs(chain: list[tuple], ranks: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Results for all rows of ``chain`` but the last."""
    changed = [edited(a[1], b[1]) for a, b in zip(chain, chain[1:])]
    new = digests(changed, ranks)
    rows = chain[:-1]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], kind), pa.array([len(r[1]) for r in rows], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
         pa.array([as_text(r[2]) for r in rows], pa.string()), pa.array([as_text(d) for d in new], pa.string()),
         pa.array([likeness(r[2], d) for r, d in zip(rows, new)], pa.float64()),
         pa.array([likeness(a[2], b[2]) for a, b in zip(chain, chain[1:])], pa.float64())],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
