"""Run records kept as XML: job history, delete ledger, script history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RecordShape:
    """Element names and field types of one kind of record."""

    root: str
    row: str
    ids: tuple[str, ...]
    texts: tuple[str, ...]
    counts: tuple[str, ...]

    @property
    def fields(self) -> tuple[str, ...]:
        return self.ids + self.texts + self.counts


# The three record layouts.
HISTORY = RecordShape(
    "histories", "history", ("stmt_id",),
    ("job_name", "target_table", "run_at", "status", "message"), ("delete_rows", "insert_rows"),
)
DELETE_LEDGER = RecordShape(
    "delete_ops", "delete_op", ("stmt_id",),
    ("job_name", "target_connection_name", "target_table", "sql_delete", "run_at"),
    ("rows_deleted",),
)
SCRIPT_HISTORY = RecordShape(
    "runs", "run", ("connection_id",),
    ("filename", "connection_name", "run_at", "status", "message"), (),
)


def _count(c: str) -> Column:
    """Digits as a number, anything else NULL."""
    text = F.trim(F.col(c))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).alias(c)


def read_records(spark: SparkSession, path: str, shape: RecordShape) -> DataFrame:
    """Typed records: missing ids 0, missing texts ``''``, odd counts NULL."""
    schema = "_id string, " + ", ".join(f"{f} string" for f in shape.fields)
    raw = spark.read.format("xml").options(rowTag=shape.row).schema(schema).load(path)
    return raw.select(
        F.coalesce(F.trim("_id").try_cast("bigint"), F.lit(0)).alias("id"),
        *[F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0)).alias(c) for c in shape.ids],
        *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in shape.texts],
        *[_count(c) for c in shape.counts],
    )


def write_records(df: DataFrame, path: str, shape: RecordShape, mode: str = "append") -> None:
    """Write records with ``id`` as an attribute and the rest as elements."""
    out = df.select(
        F.col("id").cast("string").alias("_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in shape.fields],
    )
    out.write.mode(mode).format("xml").options(rootTag=shape.root, rowTag=shape.row).save(path)
