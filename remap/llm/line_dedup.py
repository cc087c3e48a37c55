"""Line deduplication: a segment-partition edit join.

A line is cut into one more segment than edits are allowed, so two lines within the
limit share a segment unchanged.  Each distinct line offers its own segments and probes,
for every length it can be near to, the few substrings that can meet a segment of a line
of that length (positions shifted by no more than the edits left on either side).  Pairs
that meet are verified with a banded bit-parallel edit distance.

Equal lines meet before anything else, so copies add nothing.  Besides its segment, an
offer carries a parity sketch of the line's characters and pairs of characters: an edit
flips few bits, so lines of a common segment that differ elsewhere fall away in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.llm.components import components
from remap.llm.language import text_slices
from remap.llm.texts import mix64, powers
from remap.session import materialize

MAX_EDITS = 2
MIN_CHARS = 30
_BASE = 0x9E3779B97F4A7C15
_CELLS = 4 << 20
_CLASSES = 31


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and where each starts."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of lines of ``length``; the last ones are the longer."""
    base, longer = length // parts, length % parts
    late = np.maximum(0, i - (parts - longer))
    return i * base + late, base + (i >= parts - longer)


def offers(texts: list[str], edits: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Row numbers, keys and whether the keys are the lines' own segments (1) or probes (0)."""
    codes, at = codes_of(texts)
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(n, _BASE), out=sums[1:])
    back = powers(n + 1, pow(_BASE, -1, 1 << 64))  # takes a substring's hash back to its start
    lengths = np.diff(at)
    parts = edits + 1
    for shorter in range(edits + 1):
        target = lengths - shorter
        for i in range(parts):
            start, size = segment(target, i, parts)
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for shift in range(low, high + 1):
                begin = start + shift
                rows = np.flatnonzero((target >= least) & (begin >= 0) & (begin + size <= lengths))
                a = at[rows] + begin[rows]
                value = (sums[a + size[rows]] - sums[a]) * back[a]
                kind = (target[rows] * parts + i).astype(np.uint64)
                yield rows, mix64(value + mix64(kind)), int(shorter == 0 and shift == 0)


def sketches(texts: list[str]) -> np.ndarray:
    """Parity of the counts of characters in 31 classes (low bits) and of pairs of neighbours (next bits).

    An edit changes two characters at most, one gone and one new, and so four pairs.
    """
    codes, at = codes_of([t + "\0" for t in texts])
    codes = codes.astype(np.uint64)
    pair = mix64(codes * np.uint64(_BASE) + np.append(codes[1:], np.uint64(0)))
    bit = np.uint64(1) << (mix64(codes) % np.uint64(_CLASSES))
    bit ^= np.uint64(1) << (np.uint64(_CLASSES) + pair % np.uint64(_CLASSES))
    bit[at[1:] - 1] = 0  # what ends a text belongs to none of its pairs
    return np.bitwise_xor.reduceat(bit, at[:-1]).astype(np.int64)


def within_edits(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether each pair is within ``edits`` insertions, deletions or replacements.

    One word of bits per pair holds the vertical differences of a band of the distance
    matrix that moves down its diagonal (bit 63 is the band's lowest row).  All pairs of
    a batch step together.
    """
    out = np.zeros(len(a), dtype=bool)
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    order = np.argsort(longest, kind="stable")
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * (longest[order[last]] + 2 * edits) <= _CELLS:
            last += 1
        rows = order[first:last]
        out[rows] = _banded([a[r] for r in rows], [b[r] for r in rows], edits)
        first = last
    return out


def _banded(a: list[str], b: list[str], k: int) -> np.ndarray:
    (x, at_x), (y, at_y) = codes_of(a), codes_of(b)
    m, n = np.diff(at_x), np.diff(at_y)
    # Row j of the band's window needs characters j-k .. j+k of a; 0 stands outside it.
    left = np.zeros((len(a), int(max(m.max(), n.max())) + 2 * k + 1), dtype=np.uint32)
    right = np.zeros((len(a), int(n.max()) + 1), dtype=np.uint32)
    left[np.repeat(np.arange(len(a)), m), k + np.arange(len(x)) - np.repeat(at_x[:-1], m)] = x + 1
    right[np.repeat(np.arange(len(a)), n), np.arange(len(y)) - np.repeat(at_y[:-1], n)] = y + 1
    one, top = np.uint64(1), np.uint64(63)
    weights = one << np.arange(63 - 2 * k, 64).astype(np.uint64)
    vp = np.full(len(a), (2**64 - 1) << (63 - k) & (2**64 - 1), dtype=np.uint64)
    vn = np.zeros(len(a), dtype=np.uint64)
    distance = np.full(len(a), k, dtype=np.int64)
    turn = m - k  # until here the band's lowest row moves down, then row m is followed along
    for j in range(int(n.max())):
        same = left[:, j : j + 2 * k + 1] == right[:, j, None]
        match = (same * weights).sum(axis=1, dtype=np.uint64)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live = j < n
        down = live & (j < turn)
        along = live & ~down
        distance += down & ((d0 >> top) == 0)
        if along.any():
            bit = np.clip(62 - (j - turn), 0, 63).astype(np.uint64)
            distance += along & ((hp >> bit) & one).astype(bool)
            distance -= along & ((hn >> bit) & one).astype(bool)
        next_vp = hn | ~((d0 >> one) | hp)
        vp, vn = np.where(live, next_vp, vp), np.where(live, (d0 >> one) & hp, vn)
    return (distance <= k) & (np.abs(m - n) <= k)


def _offer(edits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, z in text_slices(texts):
                marks = sketches(texts[a:z]) * 2
                for rows, keys, own in offers(texts[a:z], edits, least):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(line[a:z][rows]), pa.array(marks[rows] + own)],
                        ["key", "line", "mark"],
                    )

    return run


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = within_edits(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            yield batch.select([0, 1]).filter(pa.array(near))

    return run


def lines_of(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, line_no, line, h) of every line of at least ``min_chars`` characters."""
    parts = F.posexplode(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n"))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), parts.alias("line_no", "line"))
    return rows.where(F.length("line") >= min_chars).withColumn("h", F.xxhash64("line"))


def near_lines(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(a, b): hashes of different lines within ``edits``, every such pair once."""
    distinct = lines.groupBy("h").agg(F.first("line").alias("line"))
    keys = distinct.select("h", "line").mapInArrow(_offer(edits, min_chars), "key long, line long, mark long")
    probe, own = keys.alias("probe"), keys.alias("own")
    # Two segments of their own meet from both sides; the lesser hash is the probe then.
    # Each condition names both sides, so the two sides stay one and the same exchange.
    mine, theirs = F.col("probe.mark").bitwiseAND(1), F.col("own.mark").bitwiseAND(1)
    twice = F.when(F.col("probe.line") > F.col("own.line"), mine).otherwise(F.lit(0))
    flips = F.col("probe.mark").bitwiseXOR(F.col("own.mark"))
    low = ((1 << _CLASSES) - 1) << 1  # bit 0 tells own segments from probes
    met = probe.join(
        own,
        (F.col("probe.key") == F.col("own.key"))
        & (F.col("probe.line") != F.col("own.line"))
        & (theirs - twice == 1)
        & (F.bit_count(flips.bitwiseAND(F.lit(low))) <= 2 * edits)
        & (F.bit_count(flips.bitwiseAND(F.lit(low << _CLASSES))) <= 4 * edits),
    )
    # Lines of one length can meet from both sides, each by a probe of its own.
    sides = F.col("probe.line"), F.col("own.line")
    pairs = met.select(F.least(*sides).alias("a"), F.greatest(*sides).alias("b")).distinct()
    texts = pairs.join(distinct.select(F.col("h").alias("a"), F.col("line").alias("x")), "a")
    texts = texts.join(distinct.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return texts.select("a", "b", "x", "y").mapInArrow(_verify(edits), "a long, b long")


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """One row per line of at least ``min_chars`` characters: ``id_col``, line_no (from 0),
    class_doc, class_line, n_copies, n_links, is_first.

    Lines are parted by newlines.  A class holds equal lines and lines that a chain of
    edits of at most ``edits`` characters leads to; it is named by its first line, by id
    and then by place, and only there ``is_first`` holds.  ``n_copies`` counts the equal
    lines, ``n_links`` the different lines within ``edits``.

    Shorter lines are no matter of this operator.  Null and empty texts have no line.
    Null ids come first in the order.  Rows that share an id are one document: equal lines
    at the same place of it are one line.  Lines are told apart by a 64-bit hash.
    """
    lines = lines_of(df, id_col, text_col, min_chars)
    edges = materialize(near_lines(lines, edits, min_chars), "near-lines")
    links = edges.select(F.col("a").alias("h")).unionByName(edges.select(F.col("b").alias("h")))
    links = links.groupBy("h").agg(F.count("*").alias("n_links"))
    roots = components(edges, "a", "b").withColumnRenamed("node", "h")
    place = F.struct("doc_id", "line_no")
    each = lines.groupBy("h").agg(F.min(place).alias("place"), F.count("*").alias("n_copies"))
    each = each.join(links, "h", "left").join(roots, "h", "left")
    # Lines that are neither repeated nor linked name themselves and needn't be looked up.
    each = materialize(each.where("n_copies > 1 OR root IS NOT NULL"), "lines")
    first = each.where("root IS NOT NULL").groupBy("root").agg(F.min("place").alias("first"))
    known = each.join(materialize(first, "first-lines"), "root", "left")
    known = materialize(known.select("h", F.coalesce("first", "place").alias("first"), "n_copies", "n_links"), "known-lines")
    found = lines.select("doc_id", "line_no", "h").join(known, "h", "left")
    own = F.coalesce("first", place)
    return found.select(
        F.col("doc_id").alias(id_col), "line_no", own["doc_id"].alias("class_doc"), own["line_no"].alias("class_line"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (own.eqNullSafe(place)).alias("is_first"),
    )


def without_repeats(df: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without lines that ``lines`` (from ``dedup_lines``) calls repeats.

    A text left with nothing but blanks by this is dropped; texts without a repeat stay
    as they are, empty and null ones too.
    """
    repeats = lines.where("NOT is_first").groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    joined = df.join(repeats, df[id_col].eqNullSafe(repeats["_id"]), "left")
    rest = F.expr(
        f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> NOT array_contains(_gone, i)), '\\n')"
    )
    changed = F.col("_gone").isNotNull()
    kept = joined.withColumn("_rest", F.when(changed, rest).otherwise(F.col(text_col)))
    kept = kept.where(~changed | (F.trim(F.translate("_rest", "\n\t\r", "   ")) != ""))
    return kept.withColumn(text_col, F.col("_rest")).select(*df.columns)
