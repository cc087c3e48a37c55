"""Table loads and the audit rows they leave."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remap.operators.changes import merge_update, update_where
from remap.operators.numbering import assign_ids
from remap.sinks.files import (
    count_rows,
    empty_like,
    exists,
    move_in,
    recover,
    remove,
    stage,
    swap,
)

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("job_name", T.StringType()),
        T.StructField("target_table", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("delete_rows", T.LongType()),
        T.StructField("insert_rows", T.LongType()),
        T.StructField("message", T.StringType()),
    ]
)


@dataclass(frozen=True)
class LoadResult:
    job_name: str
    target_table: str
    status: str
    delete_rows: int | None
    insert_rows: int | None
    message: str = ""

    def row(self) -> tuple:
        return (
            self.job_name,
            self.target_table,
            self.status,
            self.delete_rows,
            self.insert_rows,
            self.message,
        )


def audit_frame(spark: SparkSession, results: Iterable[LoadResult]) -> DataFrame:
    """One audit row per load."""
    return spark.createDataFrame([r.row() for r in results], AUDIT_SCHEMA)


def reload_full(
    spark: SparkSession,
    build: DataFrame | Callable[[], DataFrame],
    path: str,
    *,
    job: str,
    table: str,
    ids: bool = False,
    id_order: list[Column] | None = None,
    id_column: str = "id",
    id_key: list[str] | None = None,
    count_deleted: bool = True,
) -> LoadResult:
    """Replace a table: build, stage, swap, and report the rows removed and added.

    The old rows stay readable until the new table is complete.  A failing
    source leaves them untouched and gives an ``error`` result without counts.
    ``ids`` restarts the surrogate ids at 1, in any order, which needs no
    shuffle; ``id_order`` asks for ids in a stated order.  ``id_key`` names unique,
    never-NULL columns: then only they and the order are sorted and written to number
    the rows, and the full width is written once, by the stage.
    """
    try:
        recover(spark, path)
        deleted = count_rows(spark, path) if count_deleted else None
        frame = build() if callable(build) else build
        if ids or id_order:
            frame = assign_ids(frame, id_order, output=id_column, key=id_key)
        staged = stage(frame, path)
        inserted = count_rows(spark, staged)
        swap(spark, staged, path)
    except Exception as err:  # every failure becomes an audit row
        return LoadResult(job, table, "error", None, None, _first_line(err))
    return LoadResult(job, table, "success", deleted, inserted)


def reload_truncate(
    spark: SparkSession, build: DataFrame | Callable[[], DataFrame], path: str, *, job: str,
    table: str, **ids,
) -> LoadResult:
    """Like :func:`reload_full`, but the removed rows are not counted."""
    return reload_full(spark, build, path, job=job, table=table, count_deleted=False, **ids)


def append_load(
    frame: DataFrame | Callable[[], DataFrame], path: str, *, job: str, table: str
) -> LoadResult:
    """Add rows to a table; running it twice doubles them.

    The rows are written beside the table and moved in when complete, so a failure
    leaves no file behind and gives an ``error`` result.
    """
    return multi_target_load([(table, path, frame)], job=job)[0]


def multi_target_load(
    steps: list[tuple[str, str, DataFrame | Callable[[], DataFrame] | None]], *, job: str
) -> list[LoadResult]:
    """Appends to several tables, all or none; empty steps are skipped.

    A step is (table, path, frame or function that makes it).  Every step is written
    beside its table first.  If one fails, no table changes: its result has the
    message, the others tell that they were not applied.
    """
    steps = [s for s in steps if s[2] is not None]
    staged: list[tuple[SparkSession, str, str, int]] = []
    try:
        for _, path, build in steps:
            frame = build() if callable(build) else build
            seen = Observation()
            counted = frame.observe(seen, F.count(F.lit(1)).alias("n"))
            staged.append((frame.sparkSession, stage(counted, path), path, seen.get["n"]))
        move_in([(s, a, b) for s, a, b, _ in staged])
    except Exception as err:  # every failure becomes an audit row
        for spark, source, *_ in staged:
            remove(spark, source)
        failed = min(len(staged), len(steps) - 1)
        others = f"not applied: {steps[failed][0]} failed"
        return [
            LoadResult(job, table, "error", None, None, _first_line(err) if i == failed else others)
            for i, (table, *_) in enumerate(steps)
        ]
    return [LoadResult(job, table, "success", 0, n) for (table, *_), (*_, n) in zip(steps, staged)]


Step = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def append_step(rows: DataFrame) -> Step:
    """INSERT: all of ``rows``."""
    return lambda df: (df.unionByName(rows), rows)


def update_step(condition: Column, assign: dict[str, Column]) -> Step:
    """UPDATE .. SET .. WHERE."""
    return lambda df: (update_where(df, condition, assign), df.where(condition))


def delete_step(condition: Column) -> Step:
    """DELETE .. WHERE; rows for which the condition is unknown stay."""
    hit = F.coalesce(condition, F.lit(False))
    return lambda df: (df.where(~hit), df.where(hit))


def merge_step(source: DataFrame, *, key: str, source_key: str, assign: dict[str, str]) -> Step:
    """MERGE with a matched branch."""

    def step(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        matched = df.join(source.select(F.col(source_key).alias("__key")), df[key] == F.col("__key"), "left_semi")
        return merge_update(df, source, key=key, source_key=source_key, assign=assign), matched

    return step


def multi_statement_load(
    spark: SparkSession, path: str, steps: list[Step], *, job: str, table: str
) -> LoadResult:
    """Several statements on one table as one change: all take effect or none.

    Each step sees the rows as the steps before left them.  The result is written
    once, beside the table, and swapped in; ``insert_rows`` is the sum of the rows the
    steps touched.  A failing step leaves the table as it was and gives an ``error``
    result.  The order of the steps counts, as it does for statements.
    """
    try:
        recover(spark, path)
        frame, touched = spark.read.parquet(path), 0
        for step in steps:
            frame, hit = step(frame)
            touched += hit.count()
        swap(spark, stage(frame, path), path)
    except Exception as err:  # every failure becomes an audit row
        return LoadResult(job, table, "error", None, None, _first_line(err))
    return LoadResult(job, table, "success", 0, touched)


def purge_ordered(spark: SparkSession, tables: list[tuple[str, str]]) -> DataFrame:
    """Empty tables one after the other, children before parents.

    ``tables`` lists (name, path).  Returns ``(seq, target_table,
    rows_deleted)``; a table listed twice reports 0 the second time.
    """
    rows = []
    for seq, (name, path) in enumerate(tables, start=1):
        deleted = count_rows(spark, path)
        if exists(spark, path):
            schema = spark.read.parquet(path).schema
            swap(spark, stage(empty_like(spark, schema), path), path)
        rows.append((seq, name, deleted))
    return spark.createDataFrame(rows, "seq int, target_table string, rows_deleted bigint")


def clone_schema(spark: SparkSession, source: DataFrame, path: str) -> DataFrame:
    """Write an empty table with the columns of ``source`` and read it back."""
    empty_like(spark, source.schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rebuild_table(
    spark: SparkSession, name: str, frame: DataFrame, path: str, comment: str
) -> DataFrame:
    """Drop a catalog table, create it empty, fill it and comment on it.

    ``path`` has to be new; the files of the dropped table are left alone.
    """
    quoted = ".".join(f"`{part}`" for part in name.split("."))
    spark.sql(f"DROP TABLE IF EXISTS {quoted}")
    empty_like(spark, frame.schema).write.option("path", path).saveAsTable(name)
    frame.write.insertInto(name)
    spark.sql(f"COMMENT ON TABLE {quoted} IS {_literal(comment)}")
    return spark.table(name)


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _first_line(err: Exception) -> str:
    text = str(err).strip()
    return text.splitlines()[0] if text else type(err).__name__
