"""Tables stored by a hash of their key, changed one partition at a time.

A keyed table is a Parquet folder partitioned by ``__part = pmod(xxhash64(key), parts)``,
with ``parts`` chosen from the measured size when the table is first written and kept
in ``_meta`` beside the data (a folder Spark's readers skip).  MERGE and DELETE by key
then hash the keys of their source, read only the partitions those keys fall in
(partition pruning on ``__part``), apply the whole-frame operator to that slice, and
write it back with dynamic partition overwrite: partitions without a hit are neither
read nor written, and keep their files.  The changed slice is written once to the
work folder first, so the table is never read and overwritten by the same plan, and
a job lost before the overwrite leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remap.operators.changes import delete_by_ids, merge_update
from remap.session import materialize
from remap.sinks.files import exists, remove

PART = "__part"
TARGET_BYTES = 128 << 20  # bytes of a partition, as the planner measures the input


def part_of(key: Column, parts: int) -> Column:
    """The partition of a key; a NULL key has one too, and matches nothing."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _measured_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def store_by_key(df: DataFrame, path: str, *, key: str, parts: int | None = None) -> int:
    """Write ``df`` as a keyed table at ``path``; returns its number of partitions."""
    spark = df.sparkSession
    if parts is None:
        parts = max(1, -(-_measured_bytes(df) // TARGET_BYTES))
    df.withColumn(PART, part_of(F.col(key), parts)).write.partitionBy(PART).parquet(path)
    spark.createDataFrame([(parts, key)], "parts int, key string").coalesce(1).write.mode("overwrite").json(
        f"{path}/_meta")
    return parts


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table, without the partition column."""
    return spark.read.parquet(path).drop(PART)


def _parts(spark: SparkSession, path: str) -> int:
    return int(spark.read.schema("parts int, key string").json(f"{path}/_meta").first()["parts"])


def _hit(keys: DataFrame, column: str, parts: int) -> list[int]:
    """Partitions holding the given keys: at most ``parts`` numbers reach the driver."""
    found = keys.where(F.col(column).isNotNull()).select(part_of(F.col(column), parts).alias("p")).distinct()
    return sorted(r["p"] for r in found.collect())


def _overwrite(changed: DataFrame, path: str, hit: list[int]) -> None:
    spark = changed.sparkSession
    staged = materialize(changed, "keyed-change")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    # A partition that lost all its rows is not in the write; its folder goes here.
    left = {r[0] for r in staged.select(PART).distinct().collect()}
    for p in hit:
        if p not in left and exists(spark, f"{path}/{PART}={p}"):
            remove(spark, f"{path}/{PART}={p}")


def merge_partitioned(
    spark: SparkSession, path: str, source: DataFrame, *, key: str, source_key: str, assign: dict[str, str]
) -> int:
    """MERGE (matched branch only, as :func:`merge_update`) into a keyed table; returns partitions touched."""
    parts = _parts(spark, path)
    hit = _hit(source, source_key, parts)
    if hit:
        part = spark.read.parquet(path).where(F.col(PART).isin(hit))
        _overwrite(merge_update(part, source, key=key, source_key=source_key, assign=assign), path, hit)
    return len(hit)


def delete_partitioned(spark: SparkSession, path: str, ids: DataFrame, *, key: str, id_column: str = "id") -> int:
    """DELETE the rows whose key is in ``ids`` from a keyed table; returns partitions touched."""
    parts = _parts(spark, path)
    hit = _hit(ids, id_column, parts)
    if hit:
        part = spark.read.parquet(path).where(F.col(PART).isin(hit))
        _overwrite(delete_by_ids(part, ids, key=key, id_column=id_column), path, hit)
    return len(hit)
