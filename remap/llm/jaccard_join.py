"""N-gram Jaccard join by MinHash banding.

1. Each text gets a MinHash signature of its word 5-grams, cut into bands; the number of
   bands and rows follows from the recall asked for at the threshold.
2. Texts of equal words are one class from here on, so exact copies never meet again.
3. Classes that share a band hash are candidates.  Groups with the same members in
   several bands are kept once.  A large group is dealt into blocks of bounded size, and
   every pair of blocks is a unit of work of its own.
4. A unit verifies its pairs on the full n-gram sets, each pair in the first band it
   shares, and returns link counts and a spanning forest, never the pairs.
5. Classes joined by links become components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.llm.components import components
from remap.llm.texts import gram_hashes, mix64, parse, powers
from remap.session import materialize

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
UNIT_GRAMS = 1 << 20  # n-grams in a block, on average
_CHUNK = 256  # classes compared at once
_CELLS = 8 << 20


def banding(threshold: float = THRESHOLD, recall: float = RECALL, stray: float = 0.3, stray_rate: float = 0.06) -> tuple[int, int]:
    """Bands and rows with the fewest hashes that find a pair at ``threshold`` with ``recall``.

    A pair as alike as ``stray`` must become a candidate no more often than ``stray_rate``.
    """
    best = None
    for rows in range(1, 21):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if 1 - (1 - stray**rows) ** bands <= stray_rate and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    return best


def grams(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes of every text and where each text's start; a text of fewer words is one n-gram."""
    n = np.diff(at)
    counts = np.where(n >= GRAM, n - GRAM + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    found = gram_hashes(words, GRAM)
    place = np.repeat(at[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    out = found[np.minimum(place, len(found) - 1)] if len(found) else np.zeros(len(place), np.uint64)
    for d in np.flatnonzero((n > 0) & (n < GRAM)):
        out[bounds[d]] = gram_hashes(words[at[d] : at[d + 1]], int(n[d]))[0]
    return out, bounds


def signatures(found: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each text with n-grams (the others stay 0)."""
    out = np.zeros((len(bounds) - 1, bands), dtype=np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    seeds = mix64(np.arange(1, 2 * bands * rows + 1).astype(np.uint64))
    for band in range(bands):
        value = np.full(len(some), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((found ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), bounds[some])
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + least)
        out[some, band] = value
    return out


def _sequence_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's words in order."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    out = np.zeros((2, len(n)), dtype=np.uint64)
    if len(some):
        within = np.arange(len(words)) - np.repeat(at[:-1], n)
        for i, base in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            sums = np.add.reduceat(words * powers(int(n.max()), base)[within], at[some])
            out[i, some] = mix64(sums + n[some].astype(np.uint64))
    return out[0], out[1]


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, at in parse(batch.column(1)):
                found, bounds = grams(words, at)
                found = signatures(found, bounds, bands, rows).view(np.int64)
                h1, h2 = _sequence_hashes(words, at)
                flat = pa.array(np.ascontiguousarray(found).ravel())
                offsets = pa.array(np.arange(0, len(found) * bands + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(np.diff(at)), pa.array(h1.view(np.int64)),
                     pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(offsets, flat)],
                    ["doc_id", "n_words", "h1", "h2", "bands"],
                )

    return run


def _units(bands: int, rows: int):
    """The n-gram set and bands of each candidate class, once per unit of work it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, text, wanted, units = batch.columns
            for first, last, words, at in parse(text):
                found, bounds = grams(words, at)
                keys = signatures(found, bounds, bands, rows)
                h1 = _sequence_hashes(words, at)[0].view(np.int64)
                for i in range(last - first):
                    if h1[i] != wanted[first + i].as_py():
                        continue  # another text with the same id
                    own = np.unique(found[bounds[i] : bounds[i + 1]]).tobytes()
                    mine = units[first + i].values
                    n = len(mine)
                    yield pa.RecordBatch.from_arrays(
                        [*mine.flatten(), pa.array([rep[first + i].as_py()] * n, pa.int64()),
                         pa.array([int(h1[i])] * n, pa.int64()), pa.array([own] * n, pa.binary()),
                         pa.array([keys[i].tobytes()] * n, pa.binary())],
                        ["key", "band", "lo", "hi", "block", "rep", "h1", "grams", "bands"],
                    )

    return run


class Forest:
    """Union-find that keeps the least member as root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def _overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of ``a`` with each of ``b``."""
    x, y = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(shared):
        return out

    def place(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    (ra, ca), (rb, cb) = place(a, x), place(b, y)
    step = max(1, _CELLS // max(len(a), len(b)))
    for low in range(0, len(shared), step):  # bounded tiles of the vocabulary
        size = min(step, len(shared) - low)
        m, n = np.zeros((len(a), size), np.float32), np.zeros((len(b), size), np.float32)
        for tile, r, c in ((m, ra, ca), (n, rb, cb)):
            use = (c >= low) & (c < low + size)
            tile[r[use], c[use] - low] = 1
        out += m @ n.T
    return out


def verify(
    rep: np.ndarray, block: np.ndarray, lo: int, hi: int, sets: list[np.ndarray], bands: np.ndarray, band: int, threshold: float
):
    """Links and local root of each class of one unit (arrays along ``rep``, which is ascending).

    A unit of two blocks pairs members across only; with one of them empty it has no pair.
    """
    n = len(rep)
    links, forest = np.zeros(n, dtype=np.int64), Forest(n)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    across = lo != hi
    sides = [np.flatnonzero(block == v) for v in (lo, hi)]
    for i in range(0, len(sides[0]), _CHUNK):
        a = sides[0][i : i + _CHUNK]
        for j in range(0 if across else i, len(sides[1]), _CHUNK):
            b = sides[1][j : j + _CHUNK]
            wanted = rep[a][:, None] != rep[b][None, :] if across else a[:, None] < b[None, :]
            for k in range(band):  # verified where the pair first meets
                wanted &= bands[a, k][:, None] != bands[b, k][None, :]
            wanted &= np.minimum(size[a][:, None], size[b]) >= threshold * np.maximum(size[a][:, None], size[b]) - 1e-9
            use, of = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
            if not len(use):
                continue
            a2, b2 = a[use], b[of]
            common = _overlap([sets[q] for q in a2], [sets[q] for q in b2])
            total = size[a2][:, None] + size[b2][None, :]
            near = wanted[np.ix_(use, of)] & (common * (1 + threshold) >= threshold * total - 1e-6)
            np.add.at(links, a2, near.sum(axis=1))
            np.add.at(links, b2, near.sum(axis=0))
            for p, q in zip(*np.nonzero(near)):
                forest.join(int(a2[p]), int(b2[q]))
    roots = np.array([forest.root(i) for i in range(n)], dtype=np.int64)
    return links, rep[roots]


def _verify(threshold: float):
    fields = ["rep", "links", "root"]

    def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        block, rep, h1 = (table.column(c).to_numpy() for c in ("block", "rep", "h1"))
        _, keep = np.unique(np.stack((rep, h1)), axis=1, return_index=True)  # sorted by rep, each once
        lo, hi = (int(table.column(c)[0].as_py()) for c in ("lo", "hi"))
        if len(keep) < 2 or len(np.unique(block[keep])) < len({lo, hi}):
            return None
        sets = table.column("grams").to_pylist()
        bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.uint64).reshape(len(rep), -1)
        links, root = verify(
            rep[keep], block[keep], lo, hi, [np.frombuffer(sets[k], np.uint64) for k in keep], bands[keep],
            int(table.column("band")[0].as_py()), threshold,
        )
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[keep][some]), pa.array(links[some]), pa.array(root[some])], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # sorted, so that the rows of a unit follow each other
            unit = np.stack([batch.column(k).to_numpy() for k in (0, 2, 3)])
            cuts = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
                now = tuple(unit[:, a])
                if held and now != last:
                    if (done := close(held)) is not None:
                        yield done
                    held = []
                held.append(batch.slice(a, z - a))
                last = now
        if held and (done := close(held)) is not None:
            yield done

    return run


def join_near(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, class_id, copy_of, n_copies, n_links.

    Texts of equal words are copies of each other: ``copy_of`` is the least id among
    them, ``n_copies`` their number.  ``n_links`` is the number of texts of other words
    whose word 5-grams have a Jaccard similarity of ``threshold`` or more to this one's.
    ``class_id`` is the least id that copies and links lead to.

    A text of one to four words is a single n-gram.  A null or empty text, or one without
    words, is like nothing: its own class, no link, one copy.  A row with a null id has a
    null class and takes no part.  Rows that share an id are one document.
    """
    bands, rows = banding(threshold, recall)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = docs.mapInArrow(_sign(bands, rows), "doc_id long, n_words long, h1 long, h2 long, bands array<long>")
    signed = materialize(signed, "signed")
    worded = signed.where("n_words > 0 AND doc_id IS NOT NULL")
    classes = worded.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"),
        F.first("n_words").alias("n_words"), F.first("bands").alias("bands"),
    )
    classes = materialize(classes, "classes")
    found = materialize(_links(docs, classes, bands, rows, threshold), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(found, "rep", "root").withColumnRenamed("node", "rep")
    known = classes.drop("n_words", "bands").join(links, "rep", "left").join(roots, "rep", "left")
    known = known.select(
        "h1", "h2", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rep").alias("root")
    )
    whose = signed.select("doc_id", F.when(F.col("n_words") > 0, F.col("h1")).alias("h1"), "h2")
    return whose.join(known, ["h1", "h2"], "left").select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("copy_of"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_copies", F.lit(1))).otherwise(1).alias("n_copies"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )


def _links(docs: DataFrame, classes: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """(rep, links, root) of every class with a link, per unit of work."""
    member = classes.select("rep", "h1", "n_words", F.posexplode("bands").alias("band", "key"))
    each = F.xxhash64("rep", "h1")
    groups = member.groupBy("key").agg(
        F.min("band").alias("band"), F.count("*").alias("n"), F.sum("n_words").alias("weight"),
        F.bit_xor(each).alias("x"), F.sum(each.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"),
    ).where("n > 1")
    # The same members in several bands: the first band does for all.
    groups = groups.groupBy("n", "x", "s").agg(
        F.min_by("key", "band").alias("key"), F.min("band").alias("band"), F.first("weight").alias("weight")
    )
    blocks = F.ceil(F.col("weight") / UNIT_GRAMS).cast("int")
    dealt = member.drop("n_words", "band").join(groups.select("key", "band", blocks.alias("blocks")), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", "h1"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.struct(
        "key", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block"
    )
    wanted = dealt.groupBy("rep", "h1").agg(F.collect_list(unit).alias("units"))
    texts = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("rep", "text", "h1", "units")
    schema = (
        "key long, band int, lo int, hi int, block int, rep long, h1 long, grams binary, bands binary"
    )
    units = texts.mapInArrow(_units(bands, rows), schema)
    order = ["key", "lo", "hi"]
    spread = units.repartition(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(_verify(threshold), "rep long, links long, root long")
