"""A batch of loads over tables bucketed by owner: the owner join is shuffled once.

Details and the owner crosswalk are stored once as catalog tables bucketed (and
sorted) by ``(old_id, __salt)`` with the same number of buckets.  Every load of the
batch then joins them bucket to bucket: the plan has no exchange at the owner join,
however many loads read the pair.

A hot owner would fill one bucket and one task.  So detail rows take a salt from a
hash of their row id (``salts`` values) and the crosswalk is stored once per salt: a
hot owner's rows fall into ``salts`` buckets, and the crosswalk costs ``salts`` times
its two narrow columns.

A bucket is one join task, which sorts its rows of both sides.  So the bucket count
comes from the rows and value bytes counted on both sides, never from file sizes:
these are compressed and say little about the rows in memory.  Rows are dealt by
bucket before they are written, so a bucket is one file and one task's sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remap.operators.sizing import measure
from remap.session import materialize, new_path

SALT = "__salt"
SALTS = 8
BUCKET_BYTES = 32 << 20  # of both sides as measured; sorted rows take about three times that


def _store(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    df.repartition(buckets, key, SALT).write.bucketBy(buckets, key, SALT).sortBy(key, SALT).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def bucket_by_owner(
    spark: SparkSession,
    details: DataFrame,
    owners: DataFrame,
    *,
    key: str = "old_id",
    row_id: str = "detail_id",
    buckets: int | None = None,
    salts: int = SALTS,
) -> tuple[DataFrame, DataFrame]:
    """Store details and crosswalk (``key``, owner_id) bucketed alike; return both tables."""
    if buckets is None:
        owners = materialize(owners, "crosswalk")
    tag = uuid.uuid4().hex[:12]
    salted = details.withColumn(SALT, F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)).cast("int"))
    copies = owners.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if buckets is None:
        size = measure(salted)[1] + measure(copies)[1]
        buckets = max(1, -(-size // BUCKET_BYTES))
    detail_table = _store(salted, f"bucketed_detail_{tag}", new_path(spark, "bucketed-detail"), key, buckets)
    owner_table = _store(copies, f"bucketed_owner_{tag}", new_path(spark, "bucketed-owner"), key, buckets)
    return detail_table, owner_table


def attach_owner_bucketed(details: DataFrame, owners: DataFrame, *, key: str = "old_id") -> DataFrame:
    """The inner owner join of two tables from :func:`bucket_by_owner`, bucket to bucket."""
    return details.join(owners, [key, SALT]).drop(SALT)
