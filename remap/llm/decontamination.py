"""Benchmark decontamination by winnowing.

A fingerprint is the smallest k-gram hash of each run of ``w`` k-grams, k and w
chosen so that k + w - 1 words make a benchmark window: any shared window has a
fingerprint in common, at the same place.  Fingerprints of documents meet those of
the items, and each hit is extended word by word; where at least a whole window
agrees, its words are hit.  An item shorter than a window is one window of its own
length; its only k-gram is its fingerprint.

The items travel to the tasks in blocks of bounded size (``BLOCK_CHARS``).  The
documents pass the blocks one after the other within the same tasks, so nothing is
shuffled, and a benchmark of any size takes bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.llm.texts import gram_hashes, parse

WINDOW = 10  # words
GRAM = 5
BLOCK_CHARS = 16_000_000  # of items sent to the tasks at once
_BITS = 22


def winnow(grams: np.ndarray, at: np.ndarray, w: int, gram: int) -> np.ndarray:
    """Positions of the smallest hash in each run of ``w`` k-grams of one text (the first of equals).

    ``at`` has the word offsets of the texts; k-grams and runs that cross a text don't count.
    """
    inside = np.zeros(len(grams) + 1, dtype=np.int64)  # words left in the text from each position
    ends = np.repeat(at[1:], np.diff(at))[: len(grams)]
    left = ends - np.arange(len(grams))
    inside[:-1] = left
    runs = len(grams) - w + 1
    if runs <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(runs)
    for i in range(1, w):
        other = np.arange(i, i + runs)
        best = np.where(grams[other] < grams[best], other, best)
    return np.unique(best[inside[:runs] >= w + gram - 1])


@dataclass
class Items:
    """One block of benchmark items as word hashes, apart by gaps no word matches."""

    ids: list[str]  # per row; rows of one id count as one item
    words: np.ndarray
    offsets: np.ndarray  # first word of each row; gaps lie between rows
    lengths: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]]) -> Items:
        ids, parts, offsets, lengths, at = [], [], [], [], WINDOW
        parts.append(np.zeros(WINDOW, np.uint64))
        if rows:
            for first, last, words, bounds in parse(pa.array([t for _, t in rows], pa.string())):
                for i in range(first, last):
                    own = words[bounds[i - first] : bounds[i - first + 1]]
                    if len(own):
                        ids.append(rows[i][0])
                        parts += [own, np.zeros(WINDOW, np.uint64)]
                        offsets.append(at)
                        lengths.append(len(own))
                        at += len(own) + WINDOW
        return cls(ids, np.concatenate(parts), np.array(offsets, np.int64), np.array(lengths, np.int64))

    def index(self, window: int = WINDOW, gram: int = GRAM) -> Index:
        long = self.lengths >= window
        keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if long.any():
            hashes = gram_hashes(self.words, gram)
            own = np.concatenate([np.arange(o, o + n - gram + 1) for o, n in zip(self.offsets[long], self.lengths[long])])
            bounds = np.concatenate(([0], np.cumsum(self.lengths[long] - gram + 1)))
            # Positions within the long rows only; a run must not cross a row.
            picked = []
            for a, z in zip(bounds, bounds[1:]):
                picked.append(own[a:z][winnow(hashes[own[a:z]], np.array([0, z - a + gram - 1]), window - gram + 1, gram)])
            at = np.concatenate(picked)
            keys[0] = _sorted(hashes[at], at)
        for n in np.unique(self.lengths[~long]):
            at = self.offsets[self.lengths == n]
            keys[int(n)] = _sorted(gram_hashes(self.words, int(n))[at], at)
        return Index(self, keys, window, gram)


def _sorted(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    return hashes[order], at[order]


class Index:
    """Fingerprints of a block of items: by length of the item, 0 for those of a window or more."""

    def __init__(self, items: Items, keys: dict, window: int, gram: int):
        self.items, self.keys, self.window, self.gram = items, keys, window, gram
        self.seen = {}
        for n, (hashes, _) in keys.items():
            self.seen[n] = np.zeros(1 << _BITS, dtype=bool)
            self.seen[n][hashes >> np.uint64(64 - _BITS)] = True

    def _meet(self, n: int, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a document position of ``at`` and an item position with equal hash."""
        keys, places = self.keys[n]
        maybe = np.flatnonzero(self.seen[n][hashes >> np.uint64(64 - _BITS)])
        first = np.searchsorted(keys, hashes[maybe], side="left")
        count = np.searchsorted(keys, hashes[maybe], side="right") - first
        rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at[maybe], count), places[np.repeat(first, count) + rank]

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item row and word range (end exclusive) of every stretch hit, over the texts of a slice."""
        found = []
        ends = np.repeat(at[1:], np.diff(at))
        starts = np.repeat(at[:-1], np.diff(at))
        for n in self.keys:
            size = n or self.gram
            hashes = gram_hashes(words, size)
            if not len(hashes):
                continue
            if n:
                picked = np.flatnonzero(ends[: len(hashes)] - np.arange(len(hashes)) >= n)
            else:
                picked = winnow(hashes, at, self.window - self.gram + 1, self.gram)
            mine, theirs = self._meet(n, hashes[picked], picked)
            a, z, shift = mine.copy(), mine + size, theirs - mine
            good = np.ones(len(a), bool)
            for i in range(size):  # the hash stands for the words; compare them too
                good &= words[mine + i] == self.items.words[theirs + i]
            a, z, shift = a[good], z[good], shift[good]
            if not n:
                reach = self.window - self.gram  # every window that holds the fingerprint
                low, high = starts[a], ends[a]
                left, right = np.ones(len(a), bool), np.ones(len(a), bool)
                for _ in range(reach):
                    left &= a > low
                    left &= words[np.maximum(a - 1, 0)] == self.items.words[a - 1 + shift]
                    a = a - left
                    right &= z < high
                    right &= words[np.minimum(z, len(words) - 1)] == self.items.words[np.minimum(z + shift, len(self.items.words) - 1)]
                    z = z + right
                whole = z - a >= self.window
                a, z, shift = a[whole], z[whole], shift[whole]
            row = np.searchsorted(self.items.offsets, a + shift, side="right") - 1
            found.append((row, a, z))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of each row with n_words, n_hit, n_items, items, items_sha256,
    contaminated and ``spans``, the hit stretches as word ranges (end exclusive).

    Null and empty texts have no words and are clean.  Every row is judged by itself,
    so repeated rows get equal results.  An item row with a null id hits words but
    isn't counted or listed; rows of one id are one item.  With an empty benchmark
    every row is clean.  A column of ``keep`` with an output's name is replaced.
    """
    outputs = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans")
    keep = [c for c in keep if c not in outputs]
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)]
    state = "text string, found binary, hit_items array<string>"
    types = [f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, names)]
    out = docs.select(
        *cols, F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("binary").alias("found"),
        F.lit(None).cast("array<string>").alias("hit_items"),
    )
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).collect()  # a bounded block
        block = spark.sparkContext.broadcast(Items.of([tuple(r) for r in rows]))
        last = i == blocks - 1
        schema = state if not last else (
            "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
            "contaminated boolean, spans array<struct<start:int,end:int>>"
        )
        out = out.mapInArrow(_pass(block, names, last), ", ".join([*types, schema]))
    return out.toDF(*keep, *outputs)


def _pass(block, names: list[str], last: bool):
    """Hold the texts of a batch against one block of items; the last pass closes the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value.index()
        for batch in batches:
            text, found, listed = batch.columns[len(names) :]
            for first, end, words, at in parse(text):
                row, a, z = index.hits(words, at)
                doc = np.searchsorted(at, a, side="right") - 1
                by_doc: dict[int, list[int]] = {}
                for k, d in enumerate(doc.tolist()):
                    by_doc.setdefault(d, []).append(k)
                spans, ids = [], []
                for d in range(end - first):
                    mine = np.array(by_doc.get(d, []), dtype=np.int64)
                    now = np.stack((a[mine] - at[d], z[mine] - at[d]), axis=1).astype(np.int32)
                    past = found[first + d].as_py()
                    if past:
                        now = np.concatenate((np.frombuffer(past, np.int32).reshape(-1, 2), now))
                    spans.append(merge(now))
                    own = {index.items.ids[r] for r in row[mine]} | set(listed[first + d].as_py() or ())
                    ids.append(sorted(x for x in own if x is not None))
                kept = [c[first:end] for c in batch.columns[: len(names)]]
                yield _close(kept, names, spans, ids, np.diff(at)) if last else pa.RecordBatch.from_arrays(
                    [*kept, text[first:end], pa.array([s.tobytes() for s in spans], pa.binary()),
                     pa.array(ids, pa.list_(pa.string()))],
                    [*names, "text", "found", "hit_items"],
                )

    return run


def merge(spans: np.ndarray) -> np.ndarray:
    """Disjoint ranges that cover the same words, in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[fresh, 0], reach[np.append(fresh[1:], len(spans)) - 1]), axis=1)


def _close(kept: list, names: list[str], spans: list[np.ndarray], ids: list[list[str]], n_words: np.ndarray) -> pa.RecordBatch:
    hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [*kept, pa.array(n_words.astype(np.int64)), pa.array(hit, pa.int64()),
         pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.string())),
         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()),
         pa.array([n > 0 for n in hit], pa.bool_()),
         pa.array([[{"start": int(a), "end": int(z)} for a, z in s] for s in spans], span)],
        [*names, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"],
    )
