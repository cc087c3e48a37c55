"""Batches over tables bucketed by owner: no exchange at the owner join, hot owners spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.operators.crosswalk import attach_owner
from remap.plans import bucketed
from remap.plans.bucketed import attach_owner_bucketed, bucket_by_owner
from remap.session import new_path


def test_owner_join_has_no_exchange_and_spreads_a_hot_owner(spark):
    rows = [(i, 7 if i % 3 == 0 else i % 50, "OPEN" if i % 2 else None) for i in range(3000)]
    details = spark.createDataFrame(rows, "detail_id long, old_id long, action string")
    owners = spark.createDataFrame([(o, 1000 + o) for o in range(50)], "old_id long, owner_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d, o = bucket_by_owner(spark, details, owners, buckets=16, salts=4)
        joined = attach_owner_bucketed(d.where("action = 'OPEN'"), o)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        expected = attach_owner(details.where("action = 'OPEN'"), owners)
        cols = ["detail_id", "old_id", "action", "owner_id"]
        assert sorted(map(tuple, joined.select(cols).collect())) == sorted(map(tuple, expected.select(cols).collect()))
        files = d.where("old_id = 7").select(F.input_file_name()).distinct().count()
        assert files > 1  # the hot owner lies in several buckets
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_follow_the_rows_not_the_file_size(spark, monkeypatch):
    """Rows that Parquet packs to next to nothing still make their share of buckets, one file each."""
    path = new_path(spark, "details")
    spark.range(200_000).selectExpr("id AS detail_id", "id % 100 AS old_id", "'OPEN' AS action").write.parquet(path)
    owners = spark.range(100).selectExpr("id AS old_id", "id + 1000 AS owner_id")
    monkeypatch.setattr(bucketed, "BUCKET_BYTES", 1 << 20)
    d, o = bucket_by_owner(spark, spark.read.parquet(path), owners)
    sizes = [r["count"] for r in d.groupBy(F.input_file_name()).count().collect()]
    assert 5 <= len(sizes) <= 8 and max(sizes) < 200_000 // 3
    assert attach_owner_bucketed(d, o).where("owner_id = old_id + 1000").count() == 200_000
