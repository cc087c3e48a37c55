"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on.  Adaptive execution coalesces small
# shuffle partitions and splits hot ones; forcing the skew-join rule keeps the
# split even where it costs one more exchange further down.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_fallback_dir: str | None = None
_written: list[str] = []
_kept: list[str] = []  # tables that outlive the load that made them


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and
    the session is a single process (as in tests) a fresh local folder is used; on a
    cluster it would be another disk for every executor, so there it is an error.
    """
    global _fallback_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="run-remap-", dir="/tmp")
    return _fallback_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the work folder that no other run uses."""
    return f"{work_dir(spark)}/remap/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    Cuts lineage on shared storage, so a lost executor never replays the work
    above it and every reader sees exactly the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    _written.append(path)  # a write that fails may leave files too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recording() -> Iterator[list[str]]:
    """Collects the paths of the intermediate tables written inside, for :func:`release`."""
    before, paths = set(_written), []
    try:
        yield paths
    finally:
        paths += [p for p in _written if p not in before]


def keep(df: DataFrame) -> DataFrame:
    """Leave the tables behind ``df`` to :func:`release` without paths; they serve more than one load."""
    for file in df.inputFiles():
        for path in list(_written):
            if f"/{path.rpartition('/')[2]}/" in file:
                _written.remove(path)
                _kept.append(path)
    return df


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete intermediate tables: those of ``paths``, or all this process wrote."""
    from remap.sinks.files import remove

    gone = _written + _kept if paths is None else [p for p in _written if p in set(paths)]
    for path in gone:
        remove(spark, path)
        (_written if path in _written else _kept).remove(path)
    return len(gone)
