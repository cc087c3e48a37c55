"""Table folders on any Hadoop file system."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, s = _fs(spark, source)
    _, t = _fs(spark, target)
    if not fs.rename(s, t):
        raise OSError(f"cannot rename {source} to {target}")


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, 0 where there is none (reads footers only)."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def stage(df: DataFrame, path: str) -> str:
    """Write the frame beside its target and return the staging path."""
    staged = f"{path}__stage_{uuid.uuid4().hex}"
    try:
        df.write.parquet(staged)
    except Exception:
        remove(df.sparkSession, staged)
        raise
    return staged


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put the staged table in place; the old one goes last."""
    backup = f"{path}__old"
    recover(spark, path)
    if exists(spark, path):
        _rename(spark, path, backup)
    _rename(spark, staged, path)
    if exists(spark, backup):
        remove(spark, backup)


def move_in(staged: list[tuple[SparkSession, str, str]]) -> None:
    """Move the files of staged tables into their tables; (session, staged, table) each.

    File names are unique, so nothing is overwritten.  If a move fails, the files that
    were moved are taken out again.
    """
    moved: list[tuple[SparkSession, str]] = []
    try:
        for spark, source, path in staged:
            fs, folder = _fs(spark, source)
            fs.mkdirs(_fs(spark, path)[1])
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if not name.startswith(("_", ".")):
                    _rename(spark, f"{source}/{name}", f"{path}/{name}")
                    moved.append((spark, f"{path}/{name}"))
            remove(spark, source)
    except Exception:
        for spark, file in moved:
            remove(spark, file)
        raise


def recover(spark: SparkSession, path: str) -> None:
    """Undo a swap that stopped half way: bring the old table back."""
    backup = f"{path}__old"
    if exists(spark, backup):
        if exists(spark, path):
            remove(spark, backup)
        else:
            _rename(spark, backup, path)


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
