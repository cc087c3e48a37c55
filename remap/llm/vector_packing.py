"""Packing as vector bin packing with the dot-product heuristic.

An item is a vector: tokens, segments, loss-bearing tokens.  A bin takes, as long as
anything fits, the item whose demands point most along what the bin has left (the
largest dot product, each dimension weighted by its mean demand).  A bin never passes
any of its limits.

Items are packed in blocks within each task, so there is no shuffle and no group to
collect; what a block leaves in its last, open bin goes on to the next block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.llm.tokens import CACHE_CHUNKS, encoder

BLOCK_ITEMS = 256
BLOCK_TOKENS = 4_000_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold of each dimension."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], dtype=np.int64)


def choose(left: np.ndarray, demand: np.ndarray, open_items: np.ndarray, limits: np.ndarray, weights: np.ndarray) -> int:
    """The open item that fits with the largest dot product (the first of equals), or -1."""
    fits = open_items & (demand <= left).all(axis=1)
    if not fits.any():
        return -1
    along = demand @ (weights * left / (limits.astype(np.float64) ** 2))
    return int(np.argmax(np.where(fits, along, -1.0)))


def weigh(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Mean demand of each dimension, as a share of its limit."""
    return (demand / limits).mean(axis=0) if len(demand) else np.ones(len(limits))


def pack_whole(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of whole items; an item beyond a limit by itself gets a bin of its own."""
    alone = (demand > limits).any(axis=1)
    bins = [[int(i)] for i in np.flatnonzero(alone)]
    waiting = ~alone
    weights = weigh(demand[waiting], limits)
    while waiting.any():
        left, own = limits.copy(), []
        while (i := choose(left, demand, waiting, limits, weights)) >= 0:
            waiting[i] = False
            left = left - demand[i]
            own.append(i)
        bins.append(own)
    return bins


def pack_examples(
    df: DataFrame, id_col: str, size_cols: Sequence[str], limits: Sequence[int], block: int = BLOCK_ITEMS
) -> DataFrame:
    """``id_col`` with bin_id, slot (from 0) and oversize, for examples that must stay whole.

    ``size_cols`` are the dimensions (tokens, segments, loss-bearing tokens or any
    other); a null size counts as 0.  An example beyond a limit is alone in its bin and
    marked oversize.  Repeated rows are packed as often as they occur.
    """
    most = np.array(list(limits), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                demand = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1)
                bins = pack_whole(demand, most)
                rows = np.array([i for b in bins for i in b], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)),
                     pa.array(np.repeat(base + count + np.arange(len(bins)), [len(b) for b in bins])),
                     pa.array([k for b in bins for k in range(len(b))], pa.int32()),
                     pa.array((demand[rows] > most).any(axis=1))],
                    ["id", "bin_id", "slot", "oversize"],
                )
                count += len(bins)

    id_type = df.schema[id_col].dataType.simpleString()
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"s{i}") for i, c in enumerate(size_cols)]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), *cols)
    return rows.mapInArrow(run, f"id {id_type}, bin_id long, slot int, oversize boolean").withColumnRenamed("id", id_col)


@dataclass
class _Document:
    key: object
    ids: np.ndarray


@dataclass
class _Piece:
    doc: _Document
    start: int
    length: int

    @property
    def demand(self) -> tuple[int, int, int]:
        """A document's first token has nothing to be predicted from, so it bears no loss."""
        return self.length, 1, self.length - (self.start == 0)


class Packer:
    """Packs the pieces of one task's documents; closed sequences are lists of pieces."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.waiting: list[_Piece] = []
        self.closed: list[list[_Piece]] = []
        self.most = min(limits.tokens, limits.loss_tokens)

    def add(self, doc: _Document) -> None:
        """Full sequences leave at once; what is left of a document waits to be packed."""
        n, at = len(doc.ids), 0
        while n - at >= self.most:
            self._close([_Piece(doc, at, self.most)])
            at += self.most
        if at < n:
            self.waiting.append(_Piece(doc, at, n - at))

    def pack(self, final: bool) -> None:
        """Fill bins from the waiting pieces; an unfilled last bin waits on unless ``final``."""
        limits = self.limits.vector
        pieces, self.waiting = self.waiting, []
        demand = np.array([p.demand for p in pieces], dtype=np.int64).reshape(-1, 3)
        waiting = np.ones(len(pieces), dtype=bool)
        weights = weigh(demand, limits)
        while waiting.any():
            left, own = limits.copy(), []
            while (left > 0).all():
                i = choose(left, demand, waiting, limits, weights)
                if i >= 0:
                    waiting[i] = False
                    piece = pieces[i]
                elif waiting.any():  # nothing fits whole: cut the smallest piece that overflows
                    i = int(np.argmin(np.where(waiting, demand[:, 0], np.iinfo(np.int64).max)))
                    room = int(min(left[0], left[2]))
                    whole = pieces[i]
                    piece = _Piece(whole.doc, whole.start, room)
                    pieces[i] = _Piece(whole.doc, whole.start + room, whole.length - room)
                    demand[i] = pieces[i].demand
                else:
                    break
                own.append(piece)
                left = left - piece.demand
            if not final and not waiting.any() and (left > 0).all():
                self.waiting = own
            else:
                self._close(own)

    def _close(self, pieces: list[_Piece]) -> None:
        """A sequence that would need padding is laid out as sequences of powers of two."""
        total = sum(p.length for p in pieces)
        if total == self.limits.tokens or total & (total - 1) == 0:
            self.closed.append(pieces)
            return
        rest = list(pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            own = []
            while size:
                p = rest.pop(0)
                if p.length > size:
                    rest.insert(0, _Piece(p.doc, p.start + size, p.length - size))
                    p = _Piece(p.doc, p.start, size)
                own.append(p)
                size -= p.length
            self.closed.append(own)


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None,
    end_id: int = 0, with_ids: bool = False, cache: int = CACHE_CHUNKS,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the text of a tokenizer file.  A document is its ids and then
    ``end_id``; a null or empty text is ``end_id`` alone.  Documents longer than a
    sequence are cut without loss; every id lies in one piece.  Sequences hold at most
    ``limits`` of tokens, pieces and loss-bearing tokens, and are exactly full or a
    power of two long, so they need no padding.  ``with_ids`` adds the ids; ``cache``
    trades a worker's memory for the tokenizer's time and changes no result.  Repeated
    rows and null ids are packed like any other row; an empty table gives no rows.
    """
    limits = limits or Limits()
    spec = df.sparkSession.sparkContext.broadcast(tokenizer)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, tokens = TaskContext.get().partitionId() << 33, 0, 0
        packer, end = Packer(limits), np.array([end_id], dtype=np.uint32)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                keys = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(keys, encoder(spec.value, cache).encode(texts)):
                    packer.add(_Document(key, np.concatenate((ids, end))))
                    tokens += len(ids)
                if len(packer.waiting) >= BLOCK_ITEMS or tokens >= BLOCK_TOKENS:
                    packer.pack(final=False)
                    yield _rows(packer.closed, base + count, kind, with_ids)
                    count, tokens = count + len(packer.closed), 0
                    packer.closed = []
        packer.pack(final=True)
        if kind is not None:
            yield _rows(packer.closed, base + count, kind, with_ids)

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = (
        f"id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + ", ids binary" * with_ids
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _rows(sequences: list[list[_Piece]], first_id: int, kind: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    pieces = [p for s in sequences for p in s]
    lengths = np.array([p.length for p in pieces], dtype=np.int64)
    counts = np.array([len(s) for s in sequences], dtype=np.int64)
    ends = np.cumsum(lengths)
    head = np.cumsum(counts) - counts  # first piece of each sequence
    offset = ends - lengths - np.repeat((ends - lengths)[head], counts) if len(pieces) else lengths
    raw = [p.doc.ids[p.start : p.start + p.length].astype("<u4").tobytes() for p in pieces]
    arrays = [
        pa.array([p.doc.key for p in pieces], kind), pa.array([p.start for p in pieces], pa.int64()),
        pa.array(lengths), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
        pa.array([len(p.doc.ids) for p in pieces], pa.int64()),
        pa.array(np.repeat(first_id + np.arange(len(sequences)), counts).astype(np.int64)), pa.array(offset),
    ]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        arrays.append(pa.array(raw, pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)
