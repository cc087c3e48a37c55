"""Trigram postings find what a scan finds, and read postings, not texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from remap.operators import search_index
from remap.operators.reports import search
from remap.operators.search_index import add_postings, index_texts, postings, search_indexed
from remap.session import new_path

ROWS = [
    (1, "LOAD_B_7 nightly", "Hà Nội"), (2, "load_b_70", None), (3, "b 7 apart", "ha noi"),
    (4, None, "Đà Nẵng ưu tiên"), (5, "7_b_daol", "x"), (6, "ab", "hà nội again"),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, "id long, job string, place string")


@pytest.mark.parametrize("keyword", ["b_7", "LOAD", "oad_b", "   ", "", "hà nội", "ưu", "nẵng ưu", "zz", "ab", "b 7 a"])
def test_same_as_a_scan(spark, logs, keyword):
    path = new_path(spark, "postings")
    index_texts(logs, path, id_col="id", columns=["job", "place"])
    got = search_indexed(spark, path, logs, keyword, id_col="id", columns=["job", "place"])
    want = search(logs, keyword, ["job", "place"])
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_postings_grow_with_the_log(spark, logs):
    path = new_path(spark, "postings")
    index_texts(logs.where("id <= 3"), path, id_col="id", columns=["job"])
    add_postings(logs, path, id_col="id", columns=["job"], above=3)
    got = search_indexed(spark, path, logs, "b_7", id_col="id", columns=["job"])
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_lookup_reads_postings_by_gram(spark, logs):
    path = new_path(spark, "postings")
    index_texts(logs, path, id_col="id", columns=["job"])
    plan = spark.read.parquet(path).where("gram IN ('b_7', 'oad')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [b_7,oad])]" in plan


def test_a_gram_of_every_text_spreads_over_tasks(spark):
    path = new_path(spark, "postings")
    logs = spark.range(20_000).selectExpr("id", "concat('job_', id % 7) AS job")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index_texts(logs, path, id_col="id", columns=["job"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = spark.read.parquet(path).where("gram = 'job'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 20_000
    assert search_indexed(spark, path, logs, "job_3", id_col="id", columns=["job"]).count() == 2857


def test_candidates_are_found_once(spark, logs, monkeypatch):
    """More candidates than are pushed are joined from the list written down, not sought again."""
    monkeypatch.setattr(search_index, "PUSHED_IDS", 1)
    path = new_path(spark, "postings")
    index_texts(logs, path, id_col="id", columns=["job"])
    found = search_indexed(spark, path, logs, "b_7", id_col="id", columns=["job"])
    assert path not in " ".join(found.inputFiles()) and sorted(r.id for r in found.collect()) == [1, 2]


def test_grams_are_characters_in_any_script(spark):
    text = "a\U0001f600b\nc\U0001f600b\n\U0001f680"
    grams = {text[i : i + 3] for i in range(len(text) - 2)}
    df = spark.createDataFrame([(1, text), (2, "ab"), (3, ""), (4, None)], "id long, t string")
    assert sorted((r["id"], r["gram"]) for r in postings(df, id_col="id", columns=["t"]).collect()) == sorted((1, g) for g in grams)
