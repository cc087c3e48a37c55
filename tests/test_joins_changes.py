from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from remap.functions import before_delimiter
from remap.operators.changes import (
    delete_by_ids,
    insert_if_absent,
    merge_update,
    next_id,
    update_by_key,
    update_where,
)
from remap.operators.joins import (
    composite_join,
    null_safe_join,
    repeated_keys,
    require_unique,
    top_value,
    with_one_row,
    with_scalar,
)
from remap.plans.steps import (
    duration_band,
    header_with_count,
    master_detail,
    region_map,
    scratch_id_map,
    split_teams,
)
from tests.helpers import plan, rows


def test_null_safe_join_meets_null_and_avoids_sentinels(spark):
    left = spark.createDataFrame(
        [(1, None, None, "d"), (2, "##", -1, "d"), (3, "a", 1, "d"), (4, "a", None, "d"), (5, None, None, None)],
        "i int, s string, n int, k string",
    )
    right = left.select(F.col("i").alias("j"), F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    out = null_safe_join(left, right, tolerant=[("s", "s2"), ("n", "n2")], strict=[("k", "k2")])
    assert rows(out.select("i", "j")) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_composite_join_keeps_left_rows(spark):
    left = spark.createDataFrame([(1, 2020), (1, 2021), (2, None)], "o int, y int")
    right = spark.createDataFrame([(1, 2020, 5.0)], "p int, z int, m double")
    out = composite_join(left, right, [("o", "p"), ("y", "z")]).select("o", "y", "m")
    assert rows(out) == [(1, 2020, 5.0), (1, 2021, None), (2, None, None)]


def test_one_row_and_scalar(spark):
    df = spark.range(3)
    other = spark.createDataFrame([(5, "x"), (9, "y")], "a int, b string")
    one = with_one_row(df, other, order=[F.col("a").desc()], prefix="o_")
    assert rows(one) == [(0, 9, "y"), (1, 9, "y"), (2, 9, "y")]
    none = with_one_row(df, other.where("a > 100"), order=[F.col("a").asc()], prefix="o_")
    assert rows(none) == [(0, None, None), (1, None, None), (2, None, None)]
    assert "Join" not in plan(one)
    top = with_scalar(df, "top", top_value(other, "b", [F.col("a").asc()]))
    assert rows(top) == [(0, "x"), (1, "x"), (2, "x")]


def test_repeated_keys(spark):
    df = spark.createDataFrame([("A ",), ("a",), ("b",), (None,), (None,)], "n string")
    assert rows(repeated_keys(df, [F.lower(F.trim("n")).alias("k")])) == [("a", 2), (None, 2)]
    with pytest.raises(ValueError):
        require_unique(df, ["n"], "names")


def test_merge_touches_only_matches(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    source = spark.createDataFrame([(1, "x"), (2, None), (9, "z")], "k int, w string")
    out = merge_update(target, source, key="id", source_key="k", assign={"v": "w"})
    assert rows(out) == [(1, "x"), (2, None), (3, "c")]
    with pytest.raises(ValueError):
        merge_update(target, source.union(source), key="id", source_key="k", assign={"v": "w"})


def test_update_and_delete(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, "c"), (3, None)], "id int, n string")
    cut = update_where(df, F.instr("n", ",") > 0, {"n": before_delimiter("n", ",")})
    assert rows(cut) == [(1, "a"), (2, "c"), (3, None)]
    assert rows(update_by_key(df, key="id", value=2, assign={"n": F.lit("z")}))[1] == (2, "z")
    with pytest.raises(KeyError):
        update_by_key(df, key="id", value=7, assign={"n": F.lit("z")})
    ids = spark.createDataFrame([(1,), (1,), (8,)], "id int")
    assert rows(delete_by_ids(df, ids, key="id")) == [(2, "c"), (3, None)]


def test_insert_if_absent_continues_ids(spark):
    have = spark.createDataFrame([(4, "a")], "id bigint, name string")
    want = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "name string, s int")
    assert rows(insert_if_absent(have, want, match="name")) == [(5, "b", 3), (6, "c", 1)]
    assert rows(insert_if_absent(have.limit(0), want, match="name"))[0] == (1, "a", 2)
    assert insert_if_absent(have, want.where("name = 'a'"), match="name").count() == 0


def test_next_id(spark):
    assert next_id(spark.createDataFrame([(4,), (2,)], "id bigint")).first()[0] == 5
    assert next_id(spark.createDataFrame([], "id bigint")).first()[0] == 1


def test_header_count_zero_and_hot(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "h int, t string")
    lines = spark.createDataFrame([(1,)] * 5 + [(None,)], "k int")
    assert rows(header_with_count(heads, lines, key="h", detail_key="k")) == [(1, "a", 5), (2, "b", 0)]


def test_scratch_map_takes_one_new_id_per_old(spark):
    old = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "o int, b string")
    new = spark.createDataFrame([(20, "x"), (10, "x"), (30, "y"), (40, None)], "n int, b string")
    out = scratch_id_map(old, new, old_id="o", new_id="n", business=["b"])
    assert rows(out) == [(1, 10), (2, 10), (3, 30)]


def test_master_detail(spark):
    data = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, None, 1), (4, "a", 1), (5, None, 1)], "d int, s string, n int"
    )
    parents, children = master_detail(data, business=["s", "n"], strict=["n"])
    assert rows(parents) == [(1, "a", 1), (2, "a", None), (3, None, 1)]
    assert rows(children.select("d", "parent_id")) == [(3, 3), (4, 1), (5, 3)]


def test_region_map_ignores_accents(spark):
    old = spark.createDataFrame([(1, "HÀ NỘI"), (2, "Nowhere"), (3, None)], "code int, name string")
    new = spark.createDataFrame([("N1", " Ha Nội ")], "code string, name string")
    out = region_map(old, new).select("old_code", "new_code")
    assert rows(out) == [(1, "N1"), (2, None), (3, None)]


def test_split_teams(spark):
    teams = spark.createDataFrame(
        [(1, "T1", "A, North", 3), (2, "T2", "B,South", 1), (3, "T3", "None yet", 2), (4, "T4", "C", 9)],
        "id bigint, code string, name string, status int",
    )
    have = spark.createDataFrame([(10, "North")], "id bigint, name string")
    fresh, out = split_teams(teams, have, extra="None yet")
    assert rows(fresh.select("id", "name")) == [(11, "None yet"), (12, "South")]
    assert rows(out.select("id", "name", "parent_id")) == [
        (1, "A", 10), (2, "B", 12), (3, "None yet", 11), (4, "C", None),
    ]


def test_duration_band(spark):
    bands = spark.createDataFrame([(1, "2 năm"), (2, "2 NĂM 0 ngày"), (3, "3 tháng"), (4, None)], "id bigint, title string")
    df = spark.createDataFrame([("2năm",), ("3 Tháng",), ("9 năm",), (None,)], "t string")
    out = duration_band(df, bands, title="t", output="band")
    assert rows(out) == [("2năm", 1), ("3 Tháng", 3), ("9 năm", None), (None, None)]
