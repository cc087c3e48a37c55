"""Size checks that decide between a broadcast and a shuffled join.

A side is broadcast only after its rows and bytes were counted and found under
the limit.  Above the limit the plain join is left to Spark, whose adaptive
execution sorts, merges and splits hot partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remap.session import materialize


@dataclass(frozen=True)
class BroadcastLimit:
    rows: int = 1_000_000
    bytes: int = 64 * 1024 * 1024

    def allows(self, rows: int, size: int) -> bool:
        return rows <= self.rows and size <= self.bytes


DEFAULT_LIMIT = BroadcastLimit()


def row_bytes(df: DataFrame):
    """Column with an upper estimate of the bytes in one row."""
    total = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return total.cast("bigint")


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and estimated bytes of a frame (one aggregate, nothing collected)."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def broadcast_if_small(df: DataFrame, limit: BroadcastLimit = DEFAULT_LIMIT) -> DataFrame:
    """Hint a broadcast where the measured size allows it."""
    return F.broadcast(df) if limit.allows(*measure(df)) else df


def settled(df: DataFrame, label: str, limit: BroadcastLimit = DEFAULT_LIMIT) -> DataFrame:
    """Write a grouped frame once and make it a join side.

    A frame grouped by the join key is already partitioned by it, so Spark adds
    no exchange of its own and cannot split a hot key of the other side.  Read
    back from a table it is either broadcast or given that exchange.
    """
    return broadcast_if_small(materialize(df, label), limit)
