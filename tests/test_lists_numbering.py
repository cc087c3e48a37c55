from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from remap.operators.codelists import codes_to_ids, explode_codes, explode_rows
from remap.operators.lookup import CodeDim
from remap.operators.numbering import (
    assign_ids,
    dedup_first_wins,
    first_per_key,
    number_rows,
    paginate,
    priority_order,
    rank_by_latest,
)
from tests.helpers import plan, rows

LISTS = [None, "", "a", "a;b", "a;;b", "b;a", "a;a", "a;zz", " a ; b ", "a,b", "zz"]


@pytest.fixture(scope="module")
def dim(spark):
    return CodeDim(spark.createDataFrame([(10, "a"), (9, "b")], "id bigint, code string"), normalise=True)


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(list(enumerate(LISTS)), "i int, l string")


@pytest.mark.parametrize("fold_rows", [2000, 0])
def test_codes_to_ids_forms(lists, dim, fold_rows):
    def run(**kw):
        out = codes_to_ids(lists, "l", dim, output="ids", fold_rows=fold_rows, **kw)
        return [r[0] for r in out.orderBy("i").select("ids").collect()]

    assert run() == [None, None, "10", "10,9", "10,9", "9,10", "10,10", "10", "10,9", None, None]
    assert run(form="bracketed", delimiters=",;") == [
        "[]", "[]", "[10]", "[10,9]", "[10,9]", "[9,10]", "[10,10]", "[10]", "[10,9]", "[10,9]", "[]",
    ]
    assert run(by_id=True) == [
        None, None, "[10]", "[9,10]", "[9,10]", "[9,10]", "[10]", "[10]", "[9,10]", None, None,
    ]


def test_small_code_table_needs_no_shuffle(lists, dim):
    text = plan(codes_to_ids(lists, "l", dim, output="ids"))
    assert "Exchange" not in text and "Join" not in text and "from_json" not in text


def test_hot_list_is_translated_once(spark, dim):
    """A third of all rows share one list; the result still has every row."""
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a;b' ELSE 'b;' || id END AS l")
    out = codes_to_ids(df, "l", dim, output="ids", fold_rows=0)
    counts = dict(out.groupBy("ids").count().collect())
    assert counts == {"10,9": 1000, "9": 2000}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", " a", "", "zz", "c"]), max_size=5), min_size=1, max_size=8))
def test_both_translations_match_brute_force(spark, dim, token_lists):
    table = {"a": "10", "b": "9"}
    texts = [";".join(ts) for ts in token_lists]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, l string")
    expected = [
        ",".join(table[t.strip()] for t in text.split(";") if t.strip() in table) or None for text in texts
    ]
    for fold_rows in (2000, 0):
        out = codes_to_ids(df, "l", dim, output="ids", fold_rows=fold_rows)
        assert [r[0] for r in out.orderBy("i").select("ids").collect()] == expected


def test_explode(spark, lists):
    out = explode_codes(lists, "l", keep=["i"], delimiters=",;")
    assert rows(out.where("i IN (4, 9)")) == [(4, 1, "a"), (4, 2, "b"), (9, 1, "a"), (9, 2, "b")]
    outer = explode_rows(lists, "l", output="c")
    assert rows(outer.where("i IN (0, 1, 4)").select("i", "c")) == [(0, None), (1, None), (4, "a"), (4, "b")]


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, None), (2, 5), (None, 1)], "k int, v int")
    out = first_per_key(df, ["k"], [F.col("v").asc_nulls_last()])
    assert rows(out) == [(1, 2), (2, 5), (None, 1)]
    text = plan(out)
    assert text.index("row_number(), 1, Final") < text.index("Exchange") < text.index("row_number(), 1, Partial")


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ids_are_dense_and_ordered(spark, n):
    values = list(range(n))
    random.Random(7).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(5)
    out = assign_ids(df, [F.col("v").desc()])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(i + 1, n - 1 - i) for i in range(n)]
    anyhow = assign_ids(df)
    assert sorted(r[0] for r in anyhow.collect()) == list(range(1, n + 1))
    joined = assign_ids(df, [F.col("v").asc()], key=["v"], start=10)
    assert all(r["id"] == r["v"] + 10 for r in joined.collect()) and joined.count() == n


def test_hot_group_spans_partitions(spark):
    """One group holds a third of the rows and is still numbered without gaps."""
    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 50 END AS g")
    for key in (None, ["id"]):
        out = number_rows(df, [F.col("id").desc()], within=["g"], key=key).cache()
        assert out.count() == 6000
        wrong = out.groupBy("g").agg(
            F.count("*").alias("n"), F.max("position").alias("m"), F.countDistinct("position").alias("d")
        ).where("n <> m OR n <> d")
        assert wrong.count() == 0
        hot = out.where("g IS NULL").orderBy("position").select("id").collect()
        assert [r[0] for r in hot] == list(range(5997, -1, -3))


def test_numbering_has_no_one_task_sort_of_the_data(spark):
    df = spark.range(1000).selectExpr("id", "id * 2 AS v")
    text = plan(number_rows(df, [F.col("v").asc()]))
    window = text[text.index("Window"):]
    assert "SinglePartition" not in text[: text.index("Window")]
    assert "count(1)" in window  # the only ordered window runs over one row per partition


def test_pages_and_priority(spark):
    df = spark.range(45)
    pages = paginate(df, [F.col("id").asc()])
    assert dict(pages.groupBy("page").count().collect()) == {1: 20, 2: 20, 3: 5}
    names = spark.createDataFrame([("c",), ("a",), ("DEL_x",), ("z",), ("b",)], "n string")
    out = priority_order(names, "n", ["z", "b"], exclude_prefix="DEL_")
    assert [r[0] for r in out.orderBy("position").collect()] == ["z", "b", "a", "c"]


def test_rank_by_latest(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2020-01-01', NULL, 5), (2, NULL, TIMESTAMP_NTZ'2021-01-01', 5),"
        " (3, NULL, NULL, 6), (4, NULL, NULL, 7) AS t(i, a, b, y)"
    )
    out = rank_by_latest(df, ["a", "b"], [F.col("y").desc()])
    assert [r["i"] for r in out.orderBy("rn").collect()] == [2, 1, 4, 3]


def test_dedup_first_wins(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "x"), (4, "a", "y")], "s int, t string, u string")
    out = dedup_first_wins(df, ["t", "u"], [F.col("s").asc()])
    assert rows(out) == [(1, 1, "a", "x"), (2, 2, "b", "y"), (3, 4, "a", "y")]
