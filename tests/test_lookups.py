from __future__ import annotations

import pytest

from remap.operators.crosswalk import (
    attach_owner,
    attach_owner_left_inner,
    crosswalk,
    shared_crosswalk,
)
from remap.operators.lookup import (
    CodeDim,
    DuplicateCode,
    Role,
    match_local_name,
    region_dim,
    region_table,
    resolve_codes,
    translate_region,
)
from remap.operators.sizing import BroadcastLimit, broadcast_if_small, measure
from tests.helpers import plan, rows


@pytest.fixture(scope="module")
def owners(spark):
    old = spark.createDataFrame(
        [("o1", "f1"), ("o2", None), ("o3", "f3"), ("o4", "")], "old_id string, file_no string"
    )
    new = spark.createDataFrame([(1, "f1"), (9, "f9"), (8, None), (7, "")], "id bigint, file_no string")
    detail = spark.createDataFrame(
        [(1, "o1"), (2, "o1"), (3, "o2"), (4, "o3"), (5, None), (6, "o4")], "d int, old_id string"
    )
    return detail, old, new


def test_crosswalk_modes(owners):
    detail, old, new = owners
    inner = attach_owner(detail, crosswalk(old, new)).select("d", "owner_id")
    assert rows(inner) == [(1, 1), (2, 1)]
    left = attach_owner(detail, crosswalk(old, new, how="left"), how="left").select("d", "owner_id")
    assert rows(left) == [(1, 1), (2, 1), (3, None), (4, None), (5, None), (6, None)]
    mixed = attach_owner_left_inner(detail, old, new).select("d", "owner_id")
    assert rows(mixed) == rows(inner)
    assert "LeftOuter" not in mixed._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        crosswalk(old, new, how="outer")


def test_shared_crosswalk_is_read_not_joined(owners):
    detail, old, new = owners
    shared = shared_crosswalk(crosswalk(old, new))
    out = attach_owner(detail, shared).select("d", "owner_id")
    text = plan(out)
    assert text.count("Join") == 1 and "BroadcastHashJoin" in text
    assert rows(out) == [(1, 1), (2, 1)]


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(
        [(1, "a", 0), (2, "b", 1), (3, "c", None), (4, None, 0)], "id bigint, code string, is_deleted int"
    )


@pytest.fixture(scope="module")
def coded(spark):
    return spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (4, "zz"), (5, None), (6, " a ")], "r int, code string"
    )


@pytest.mark.parametrize(
    ("rule", "normalise", "expected"),
    [
        ("ignore", False, [1, 2, 3, None, None, None]),
        ("strict", False, [1, None, None, None, None, None]),
        ("lenient", False, [1, None, 3, None, None, None]),
        ("ignore", True, [1, 2, 3, None, None, 1]),
    ],
)
def test_soft_delete_rules(coded, dim, rule, normalise, expected):
    role = Role("code", CodeDim(dim, deleted=rule, normalise=normalise), {"v": "id"})
    out = resolve_codes(coded, [role]).select("r", "v")
    assert [v for _, v in rows(out)] == expected


def test_required_lookup_drops_rows(coded, dim):
    out = resolve_codes(coded, [Role("code", CodeDim(dim), {"v": "id"}, required=True)])
    assert rows(out.select("r", "v")) == [(1, 1), (2, 2), (3, 3)]


def test_duplicate_codes(spark, coded):
    twice = spark.createDataFrame([(7, "a"), (5, "a"), (6, "b")], "id bigint, code string")
    with pytest.raises(DuplicateCode):
        resolve_codes(coded, [Role("code", CodeDim(twice), {"v": "id"})])
    first = resolve_codes(coded, [Role("code", CodeDim(twice, duplicates="first"), {"v": "id"})])
    assert rows(first.select("r", "v"))[:2] == [(1, 5), (2, 6)]
    every = resolve_codes(coded, [Role("code", CodeDim(twice, duplicates="all"), {"v": "id"})])
    assert every.count() == coded.count() + 1


def test_star_keeps_rows_and_reuses_the_broadcast(coded, dim):
    codes = CodeDim(dim)
    out = resolve_codes(coded, [Role("code", codes, {f"v{i}": "id"}) for i in range(3)])
    assert out.count() == coded.count()
    out.collect()
    text = plan(out)
    assert text.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in text


def test_large_dim_is_not_broadcast(spark, coded):
    big = spark.range(50).selectExpr("id", "cast(id AS string) AS code")
    tight = CodeDim(big, limit=BroadcastLimit(rows=10))
    assert tight.side() is tight.table()
    assert CodeDim(big).side() is not None
    out = resolve_codes(coded, [Role("code", tight, {"v": "id"})])
    assert out.count() == coded.count()


def test_measure_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([("ab", 1), ("Đ", 2)], "s string, n int")
    assert measure(df) == (2, 2 * 16 + 2 + 2)
    assert measure(df.limit(0)) == (0, 0)
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString().lower()
    tight = broadcast_if_small(df, BroadcastLimit(rows=1))
    assert "hint" not in tight._jdf.queryExecution().analyzed().toString().lower()


def test_region_translation(spark):
    mapping = spark.createDataFrame([(1, "R1"), (2, " R2"), (3, None), (4, "R9")], "old_code int, new_code string")
    new = spark.createDataFrame(
        [(10, "R1 ", 0), (20, "R2", None), (30, "R3", 1)], "id bigint, code string, is_deleted int"
    )
    table = region_dim(region_table(mapping, new))
    df = spark.createDataFrame([("a", " 1 "), ("b", "2"), ("c", "3"), ("d", "4"), ("e", None)], "k string, reg string")
    out = translate_region(df, table, {"reg": "rid", "k": "other"})
    assert rows(out.select("k", "rid", "other")) == [
        ("a", 10, None), ("b", 20, None), ("c", None, None), ("d", None, None), ("e", None, None),
    ]


def test_local_name_inside_region(spark):
    places = spark.createDataFrame(
        [(1, "R1", "Xã An"), (2, "R2", "phường An"), (3, "R1", "Xã Bo")], "id bigint, region_code string, name string"
    )
    df = spark.createDataFrame(
        [("a", "R1", "XÃ An"), ("b", "R2", "An"), ("c", "R1", "an"), ("d", None, "An"), ("e", "R1", None)],
        "k string, reg string, ward string",
    )
    out = match_local_name(
        df, places, name="ward", region="reg", prefixes=["Xã", "Phường"], output="pid"
    )
    assert rows(out.select("k", "pid")) == [("a", 1), ("b", 2), ("c", None), ("d", None), ("e", None)]


def test_star_stays_within_its_broadcast_budget(spark, coded):
    big = CodeDim(spark.range(1000).selectExpr("id", "cast(id AS string) AS code"))
    small = CodeDim(spark.createDataFrame([(1, "a")], "id bigint, code string"))
    roles = [Role("code", big, {"x": "id"}), Role("code", small, {"y": "id"})]
    from remap.operators.lookup import _within_budget

    assert _within_budget([big, small, big], small.size) == {id(small)}
    assert _within_budget([big, small], big.size + small.size) == {id(big), id(small)}
    out = resolve_codes(coded, roles, budget=small.size)
    assert rows(out.select("r", "x", "y"))[0] == (1, None, 1)


def test_join_strategy_hint(owners):
    detail, old, new = owners
    out = attach_owner(detail, crosswalk(old, new), strategy="shuffle_hash")
    assert "ShuffledHashJoin" in plan(out)


def test_number_column_meets_text_codes(spark):
    dim = spark.createDataFrame(
        [(1, "7"), (2, "007"), (3, " 8 "), (4, "x"), (5, "-1"), (6, "1.0")], "id bigint, code string"
    )
    df = spark.createDataFrame([(7,), (8,), (-1,), (1,), (None,)], "n int")
    plain = resolve_codes(df, [Role("n", CodeDim(dim), {"v": "id"})])
    assert rows(plain) == [(-1, 5), (1, None), (7, 1), (8, None), (None, None)]
    trimmed = resolve_codes(df, [Role("n", CodeDim(dim, normalise=True), {"v": "id"})])
    assert rows(trimmed) == [(-1, 5), (1, None), (7, 1), (8, 3), (None, None)]


def test_shared_hash_falls_back_to_text(spark, coded, dim):
    """A code table with two codes on one hash is joined by text instead."""
    codes = CodeDim(dim)
    assert codes.hashed
    fast = rows(resolve_codes(coded, [Role("code", codes, {"v": "id"})]))
    codes._hashed = False
    assert rows(resolve_codes(coded, [Role("code", codes, {"v": "id"})])) == fast
    assert not CodeDim(dim.union(dim), duplicates="all").hashed


def test_hash_candidate_with_other_text_is_no_match(spark, monkeypatch):
    """Force every hash to collide: text decides, rows stay whole."""
    from pyspark.sql import functions as F

    one = CodeDim(spark.createDataFrame([(1, "a")], "id bigint, code string"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "r int, code string")
    one.table()
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(42).cast("bigint") + F.length(c[0]) * 0)
    left = resolve_codes(df, [Role("code", one, {"v": "id"})])
    inner = resolve_codes(df, [Role("code", one, {"v": "id"}, required=True)])
    monkeypatch.undo()
    assert rows(left.select("r", "v")) == [(1, 1), (2, None), (3, None)]
    assert rows(inner.select("r", "v")) == [(1, 1)]
