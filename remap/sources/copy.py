"""Column copy from any Spark source to a table, bound by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """Any Spark source.  For ``jdbc`` pass ``fetchsize`` and the partition
    options so the read is split over executors."""
    return spark.read.format(fmt).options(**options).load()


def project_positional(
    source: DataFrame, columns: list[str], targets: list[str], where: str = ""
) -> DataFrame:
    """Select listed columns, filter by a free-text condition, rename by position."""
    if not columns:
        raise ValueError("no columns to copy")
    if len(columns) != len(targets):
        raise ValueError(f"{len(columns)} source columns for {len(targets)} target columns")
    rows = source.where(where) if where.strip() else source
    return rows.select(*columns).toDF(*targets)


def copy_projected(
    source: DataFrame,
    columns: list[str],
    targets: list[str],
    *,
    path: str,
    where: str = "",
    fmt: str = "parquet",
    **options: str,
) -> dict[str, int]:
    """Append the projected rows to a target and report the counts.

    Spark writes the partitions in parallel and counts the rows on the way;
    for ``jdbc`` the option ``batchsize`` sets the rows per round trip.
    """
    rows = project_positional(source, columns, targets, where)
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("append").format(fmt).options(**options).save(path)
    n = seen.get["n"]
    return {"rows_selected": n, "rows_inserted": n}
