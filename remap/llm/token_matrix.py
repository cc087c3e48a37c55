"""Packed token-id matrices: best-fit-decreasing packing with a segment tree.

Documents become ids and an end id; one longer than a row of the matrix is split
without loss.  Per block of documents the pieces are placed longest first, each into
the open row with the least room that still takes it; a segment tree over the possible
capacities finds that row.  A written row has its ids, the cumulative lengths of its
segments and the positions, which restart at each segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.llm.tokens import encoder

BLOCK_DOCS = 4096
BLOCK_TOKENS = 4_000_000


class CapacityTree:
    """How many open rows have each room, with a search for the least room of at least a size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the least room >= size."""
        at = size + self.leaves
        if not self.count[at]:
            # Up until a right sibling holds a row, then down to its leftmost leaf.
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of item indexes; every size is at most ``capacity``."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[i])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.put(room - sizes[i], row)
    return rows


@dataclass(frozen=True)
class Layout:
    """Shape and marks of the matrices; ``dtype`` must hold every id."""

    length: int = 1024
    end_id: int = 50256
    pad_id: int = 50256
    dtype: str = "<u2"


FIELDS = (
    "row_id long, ids binary, cu_seqlens array<int>, positions binary, n_tokens int, "
    "doc_ids array<{id}>, doc_starts array<long>, doc_tokens array<long>"
)


def pack_matrix(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", layout: Layout | None = None
) -> DataFrame:
    """One row per matrix row: ids, cu_seqlens, positions, and which document parts it holds.

    ``ids`` and ``positions`` are ``length`` little-endian numbers each; past
    ``n_tokens`` they are ``pad_id`` and 0.  ``cu_seqlens`` starts at 0 and ends at
    ``n_tokens``.  ``doc_starts`` tells where in its document a segment starts, so
    documents can be put together again.  A null or empty text is its end id alone;
    null ids and repeated rows are packed like others; an empty table gives no rows.
    """
    layout = layout or Layout()
    spec = df.sparkSession.sparkContext.broadcast(tokenizer)
    limit = np.iinfo(np.dtype(layout.dtype)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 33
        keys: list = []
        docs: list[np.ndarray] = []
        kind, tokens = pa.null(), 0
        end = np.array([layout.end_id], dtype=np.uint32)
        for batch in batches:
            kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                keys += part.column(0).to_pylist()
                for ids in encoder(spec.value).encode([t or "" for t in part.column(1).to_pylist()]):
                    if len(ids) and int(ids.max()) > limit:
                        raise ValueError(f"an id exceeds {layout.dtype}")
                    docs.append(np.concatenate((ids, end)))
                    tokens += len(ids) + 1
                if len(docs) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                    yield from _matrix(keys, docs, layout, row_id, kind)
                    row_id += BLOCK_DOCS + tokens  # more than the rows of the block
                    keys, docs, tokens = [], [], 0
        if docs:
            yield from _matrix(keys, docs, layout, row_id, kind)

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, FIELDS.format(id=df.schema[id_col].dataType.simpleString()))


def _matrix(keys: list, docs: list[np.ndarray], layout: Layout, row_id: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    width = layout.length
    pieces = [(d, at, min(width, len(ids) - at)) for d, ids in enumerate(docs) for at in range(0, len(ids), width)]
    rows = best_fit_decreasing([n for *_, n in pieces], width)
    for first in range(0, len(rows), 1024):
        part = rows[first : first + 1024]
        ids = np.full((len(part), width), layout.pad_id, dtype=layout.dtype)
        positions = np.zeros((len(part), width), dtype=layout.dtype)
        lengths = []
        for r, row in enumerate(part):
            at, ends = 0, [0]
            for k in row:
                d, start, n = pieces[k]
                ids[r, at : at + n] = docs[d][start : start + n]
                positions[r, at : at + n] = np.arange(n)
                at += n
                ends.append(at)
            lengths.append(ends)
        own = [[pieces[k] for k in row] for row in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_id + first + np.arange(len(part))), pa.array([x.tobytes() for x in ids], pa.binary()),
             pa.array(lengths, pa.list_(pa.int32())), pa.array([x.tobytes() for x in positions], pa.binary()),
             pa.array([e[-1] for e in lengths], pa.int32()),
             pa.array([[keys[d] for d, *_ in x] for x in own], pa.list_(kind)),
             pa.array([[at for _, at, _ in x] for x in own], pa.list_(pa.int64())),
             pa.array([[len(docs[d]) for d, *_ in x] for x in own], pa.list_(pa.int64()))],
            ["row_id", "ids", "cu_seqlens", "positions", "n_tokens", "doc_ids", "doc_starts", "doc_tokens"],
        )


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Write packed rows as Parquet with a binary id column (one fixed-size record per matrix row)."""
    matrix.write.mode("error").option("compression", "zstd").parquet(path)
