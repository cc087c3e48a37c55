"""Reloads published by pointer: a new version folder, then one catalog statement.

Each load writes its rows once into a folder of its own under the table's root
(``v-<time>-<random>``).  Readers go through a catalog table; when the new folder is
complete, ``ALTER TABLE .. SET LOCATION`` moves the table onto it in one statement,
and other versions are deleted afterwards, keeping the one before (``keep``) for
readers that are still on it.  Nothing is renamed, so an object store copies nothing, and a
failure at any point leaves a readable table:

* while the version is written: the table still points at the old version; the
  partial folder is not pointed at and goes with the next sweep;
* between the write and the statement: the same;
* after the statement, while sweeping: the table points at the new version.

A new schema cannot move by location alone: then the table is dropped and created
on the new folder (two statements; readers between them find no table).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from remap.operators.numbering import assign_ids
from remap.sinks.files import _fs, count_rows, remove
from remap.sinks.loads import LoadResult, _first_line

VERSION_PREFIX = "v-"


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def location(spark: SparkSession, name: str) -> str | None:
    """The folder a catalog table points at, None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def versions(spark: SparkSession, root: str) -> list[str]:
    """Version folders under ``root``, oldest first."""
    fs, folder = _fs(spark, root)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return [f"{root}/{n}" for n in sorted(n for n in names if n.startswith(VERSION_PREFIX))]


def sweep(spark: SparkSession, root: str, kept: set[str]) -> int:
    """Delete the version folders under ``root`` that are not in ``kept``: older and unfinished ones."""
    names = {k.rstrip("/").rpartition("/")[2] for k in kept}  # the catalog may add a scheme
    gone = [v for v in versions(spark, root) if v.rpartition("/")[2] not in names]
    for path in gone:
        remove(spark, path)
    return len(gone)


def publish(
    spark: SparkSession,
    build: DataFrame | Callable[[], DataFrame],
    name: str,
    root: str,
    *,
    job: str,
    table: str,
    keep: bool = True,
    id_order: list[Column] | None = None,
    id_column: str = "id",
    id_key: list[str] | None = None,
    _stop_after: str | None = None,
) -> LoadResult:
    """Reload catalog table ``name`` by pointer; every failure becomes an ``error`` result.

    ``id_order`` numbers the rows from 1 in that order; with ``id_key`` (unique,
    never-NULL columns) only they and the order are written to number them.  ``_stop_after`` ("write" or
    "point") raises there, for tests of the failure points.
    """
    try:
        old = location(spark, name)
        deleted = count_rows(spark, old) if old else 0
        frame = build() if callable(build) else build
        if id_order:
            frame = assign_ids(frame, id_order, output=id_column, key=id_key)
        version = f"{root}/{VERSION_PREFIX}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(version)
        inserted = count_rows(spark, version)
        if _stop_after == "write":
            raise RuntimeError("stopped after the write")
        if old is None:
            spark.sql(f"CREATE TABLE {name} USING parquet LOCATION {_quoted(version)}")
        elif spark.table(name).schema == spark.read.parquet(version).schema:
            spark.sql(f"ALTER TABLE {name} SET LOCATION {_quoted(version)}")
        else:
            spark.sql(f"DROP TABLE {name}")
            spark.sql(f"CREATE TABLE {name} USING parquet LOCATION {_quoted(version)}")
        spark.catalog.refreshTable(name)
        if _stop_after == "point":
            raise RuntimeError("stopped after the statement")
        sweep(spark, root, {version} | ({old} if keep and old else set()))
    except Exception as err:  # every failure becomes an audit row
        return LoadResult(job, table, "error", None, None, _first_line(err))
    return LoadResult(job, table, "success", deleted, inserted)
