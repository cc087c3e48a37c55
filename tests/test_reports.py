from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from remap.operators import reports as r
from tests.helpers import rows

RUNS = [
    (1, 10, "2024-01-01 00:00:00", "success"),
    (2, 10, "2024-01-02 00:00:00", "error"),
    (3, 20, "2024-01-01 00:00:00", "error"),
    (4, 20, "2024-01-02 00:00:00", "success"),
    (5, 30, "2024-01-01 00:00:00", "success"),
    (6, 30, "2024-01-01 00:00:00", "error"),
    (7, 40, "2024-01-03 00:00:00", "error"),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, "id bigint, job_id int, run_at string, status string")


def test_latest_then_filter(runs):
    assert rows(r.latest_errors(runs).select("job_id", "id")) == [(10, 2), (30, 6), (40, 7)]


def test_filter_then_latest(runs):
    assert rows(r.latest_successes(runs).select("job_id", "id")) == [(10, 1), (20, 4), (30, 5)]


def test_every_job_is_an_error_or_succeeded_last(runs):
    last_ok = r.latest_per_job(runs).where("status = 'success'").select("job_id")
    covered = r.latest_errors(runs).select("job_id").union(last_ok)
    assert rows(covered) == rows(runs.select("job_id").distinct())


def test_history_numbers_keep_log_order_on_ties(runs):
    out = r.history_by_job(runs).select("job_id", "position", "id")
    assert rows(out) == [(10, 1, 2), (10, 2, 1), (20, 1, 4), (20, 2, 3), (30, 1, 5), (30, 2, 6), (40, 1, 7)]
    whole = r.newest_first(runs).orderBy("position").select("id")
    assert [x[0] for x in whole.collect()] == [7, 2, 4, 1, 3, 5, 6]


def test_hot_job_history(spark):
    log = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS job_id", "id % 7 AS run_at"
    )
    out = r.history_by_job(log)
    assert out.count() == 3000
    hot = out.where("job_id = 1").orderBy("position").select("id", "run_at", "position").collect()
    expected = sorted([x for x in range(3000) if x % 3 == 0 or x == 1], key=lambda x: (-(x % 7), x))
    assert [h["id"] for h in hot] == expected
    assert [h["position"] for h in hot] == list(range(1, len(expected) + 1))


def test_search(spark):
    df = spark.createDataFrame([("Job A", "T1", None), ("b", "a t", "x"), ("c", None, "d")], "n string, t string, m string")
    assert rows(r.search(df, " A ", ["n", "t"]).select("n")) == [("Job A",), ("b",)]
    assert r.search(df, "a t1", ["n", "t"]).count() == 0
    assert rows(r.search(df, "a t1", ["n", "t"], joined=True).select("n")) == [("Job A",)]
    assert r.search(df, "  ", ["n"]).count() == 3


def test_retention_keeps_unreadable_times(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01 11:59:59"), (2, "2024-01-01 12:00:00"), (3, "n/a"), (4, None), (5, "")],
        "i int, run_at string",
    )
    assert [i for i, _ in rows(r.keep_recent(df, "2024-01-02 12:00:00"))] == [2, 3, 4, 5]


def test_tail_filters_after_the_limit(spark):
    df = spark.range(20).selectExpr("id AS seq", "'u' || id % 2 AS usr")
    assert [x["seq"] for x in r.tail(df, 3).collect()] == [17, 18, 19]
    assert [x["seq"] for x in r.tail(df, 3, user="u0").collect()] == [18]


def test_summary_and_resume(spark, runs):
    assert rows(r.status_summary(runs)) == [(7, 3, 4)]
    wanted = spark.createDataFrame([(10,), (50,)], "id int")
    done = runs.select(F.col("job_id").alias("id"), "status")
    assert rows(r.remaining(wanted, done)) == [(50,)]
