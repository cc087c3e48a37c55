"""One key holds a third of the rows: hot partitions are split, results stay whole."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from remap.operators.codelists import codes_to_ids
from remap.operators.crosswalk import attach_owner
from remap.operators.joins import null_safe_join
from remap.operators.lookup import CodeDim, Role, resolve_codes
from remap.operators.sizing import BroadcastLimit
from tests.helpers import plan

ROWS = 240_000
HOT = "CASE WHEN id % 3 = 0 THEN {hot} ELSE id % 5000 + 1 END"
NEVER = BroadcastLimit(rows=0)


@contextlib.contextmanager
def small_thresholds(spark):
    """Scale the skew thresholds down to test data and rule out broadcasts."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def detail(spark, hot: str, text: bool = False):
    key = HOT.format(hot=hot)
    key = f"CAST({key} AS string)" if text else key
    return spark.range(0, ROWS, 1, 8).selectExpr("id AS d", f"{key} AS k", "repeat('x', 20) AS pad")


def total(df, column: str) -> tuple:
    """Run the whole plan and count rows and non-NULL values."""
    out = df.groupBy().agg(F.count(F.lit(1)), F.count(column)).collect()[0]
    return tuple(out)


def is_split(df) -> bool:
    df.collect()
    return "skew=true" in plan(df)


@pytest.mark.parametrize(("how", "hot"), [("inner", "7"), ("left", "7"), ("left", "NULL")])
def test_hot_owner_is_split(spark, how, hot):
    owners = spark.range(1, 5001).selectExpr("id AS old_id", "id + 100 AS owner_id")
    with small_thresholds(spark):
        out = attach_owner(detail(spark, hot), owners, on="k", how=how).select("d", "owner_id", "pad")
        expected = ROWS if hot != "NULL" else ROWS - ROWS // 3
        assert total(out, "owner_id") == (ROWS, expected)
        assert is_split(out)


def test_hot_code_in_a_large_lookup_is_split(spark):
    codes = spark.range(1, 5001).selectExpr("id + 9 AS id", "CAST(id AS string) AS code")
    with small_thresholds(spark):
        dim = CodeDim(codes, limit=NEVER)
        out = resolve_codes(detail(spark, "7", text=True), [Role("k", dim, {"v": "id"})])
        assert total(out, "v") == (ROWS, ROWS)
        assert is_split(out)


def test_hot_header_in_a_null_safe_join_is_split(spark):
    heads = spark.range(0, 5001).selectExpr("id AS h", "nullif(id, 0) AS hk")
    with small_thresholds(spark):
        out = null_safe_join(detail(spark, "NULL"), heads, tolerant=[("k", "hk")])
        assert total(out, "h") == (ROWS, ROWS)
        assert is_split(out)


def test_hot_list_joined_back_is_split(spark):
    codes = spark.range(1, 5001).selectExpr("id + 9 AS id", "CAST(id AS string) AS code")
    with small_thresholds(spark):
        dim = CodeDim(codes, limit=NEVER)
        out = codes_to_ids(
            detail(spark, "7", text=True), "k", dim, output="v", fold_rows=0, limit=NEVER
        )
        assert total(out, "v") == (ROWS, ROWS)
        assert is_split(out)


def test_hot_business_key_of_a_scratch_map_is_split(spark, monkeypatch):
    from remap.plans import steps
    from remap.operators.sizing import settled

    monkeypatch.setattr(steps, "settled", lambda df, label: settled(df, label, NEVER))
    new = spark.range(1, 5001).selectExpr("id + 9 AS n", "id AS k")
    with small_thresholds(spark):
        out = steps.scratch_id_map(
            detail(spark, "7"), new.union(new), old_id="d", new_id="n", business=["k"]
        )
        assert total(out, "new_id") == (ROWS, ROWS)
        assert is_split(out)


def test_hot_key_of_a_delete_is_split(spark):
    from remap.operators.changes import delete_by_ids

    ids = spark.range(0, 10_000).selectExpr("id % 50 + 1 AS id")
    with small_thresholds(spark):
        out = delete_by_ids(detail(spark, "70"), ids, key="k", limit=NEVER)
        gone = detail(spark, "70").where("k <= 50").count()
        assert out.count() == ROWS - gone
        assert is_split(out)
