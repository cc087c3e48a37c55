"""One answer at every size, failures that leave nothing behind, numbers as codes."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remap import session
from remap.functions.text import code_text, strip_prefix
from remap.operators import reports
from remap.operators.changes import insert_if_absent, merge_update
from remap.operators.codelists import codes_to_ids
from remap.operators.lookup import CodeDim, Role, resolve_codes
from remap.operators.sizing import BroadcastLimit
from remap.plans.batch import run_batch
from remap.plans.mapping import AuditBlock
from remap.plans.spec import LoadSpec
from remap.sinks import loads
from remap.sources.catalog import column_catalog
from remap.sources.runlog import HISTORY, read_records
from tests.helpers import rows

AUDIT = AuditBlock("2026-01-01 00:00:00")
VALUES = {
    "bigint": "CAST(n AS bigint)", "string": "concat('v,', n)", "boolean": "n % 2 = 0", "double": "n / 4",
    "decimal(9,2)": "CAST(n / 4 AS decimal(9,2))", "date": "date_add(DATE'2020-01-01', n)",
    "binary": "CAST(concat('b', n) AS binary)", "struct<a:int>": "named_struct('a', n)",
    "timestamp": "CAST(concat('2020-01-01 00:00:0', n) AS timestamp)",
}


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("output", ["codes", "k", "new"])
@pytest.mark.parametrize("form, by_id", [("bare", False), ("bracketed", False), ("bare", True)])
def test_both_list_paths_agree(spark, kind, output, form, by_id):
    table = spark.range(6).selectExpr("CAST(id AS int) AS n").selectExpr("concat('c', n) AS code", f"{VALUES[kind]} AS id")
    lists = [(1, "c3;c1;c9"), (2, None), (3, ""), (4, "c9"), (5, " c0 ;c5;c5"), (6, "c3;c1;c9")]
    df = spark.createDataFrame(lists, "k int, codes string")
    dim = CodeDim(table)
    got = [codes_to_ids(df, "codes", dim, output=output, fold_rows=n, form=form, by_id=by_id) for n in (1000, 0)]
    assert got[0].columns == got[1].columns == (["k", "codes"] + ["new"] * (output == "new"))
    assert rows(got[0]) == rows(got[1]) and got[0].dtypes == got[1].dtypes


@pytest.mark.parametrize("limit", [BroadcastLimit(), BroadcastLimit(0, 0)])
def test_a_lookup_must_not_name_an_existing_column(spark, limit):
    df = spark.createDataFrame([("a", 1)], "c string, x int")
    dim = CodeDim(spark.createDataFrame([("a", 5)], "code string, id int"), limit=limit)
    for roles in ([Role("c", dim, {"x": "id"})], [Role("c", dim, {"y": "id"}), Role("c", dim, {"y": "id"})]):
        with pytest.raises(ValueError, match="existing"):
            resolve_codes(df, roles)
    assert resolve_codes(df, [Role("c", dim, {"y": "id"})]).first()["y"] == 5


def test_a_tail_is_never_shortened(spark):
    df = spark.range(6000).withColumnRenamed("id", "seq")
    assert reports.tail(df, 5500).count() == 5500
    for n in (0, 6):
        with pytest.raises(ValueError):
            reports.tail(df, n, most=5)


def test_numbers_as_codes(spark):
    df = spark.createDataFrame([(Decimal("5.00"), 5.0, 12), (Decimal("-0.50"), 1e10, 0), (Decimal("100.10"), 0.001, -3), (None, None, None)],
                               "d decimal(10,2), f double, i int")
    got = [tuple(r) for r in df.select(*(code_text(F.col(c)) for c in "dfi")).collect()]
    assert got == [("5", "5", "12"), ("-0.5", "10000000000", "0"), ("100.1", "0.001", "-3"), (None, None, None)]
    dim = CodeDim(spark.createDataFrame([("5", 1), ("100.1", 2)], "code string, id int"), normalise=True)
    found = resolve_codes(df, [Role("d", dim, {"a": "id"}), Role("f", dim, {"b": "id"})])
    assert [(r["a"], r["b"]) for r in found.collect()] == [(1, 1), (None, None), (2, None), (None, None)]


def test_prefix_words_are_taken_literally(spark):
    df = spark.createDataFrame([("Tp. Ana",), ("Tpx Ana",)], "n string")
    assert [r[0] for r in df.select(strip_prefix("n", ["Tp."])).collect()] == ["Ana", "Tpx Ana"]


def test_merge_refuses_only_a_target_row_hit_twice(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    loose = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z"), (9, "p"), (9, "q")], "sk int, nv string")
    got = merge_update(target, loose, key="k", source_key="sk", assign={"v": "nv"})
    assert rows(got) == [(1, "x"), (2, "b"), (None, "n")]
    twice = loose.unionByName(loose.where("sk = 1"))
    with pytest.raises(ValueError, match="unique"):
        merge_update(target, twice, key="k", source_key="sk", assign={"v": "nv"}).collect()


def _spec(df, name, **more):
    return LoadSpec(name, df, [("a", "a")], AUDIT, **more)


def test_a_failing_append_leaves_a_row_and_no_file(spark, tmp_path):
    good = spark.createDataFrame([(1,), (2,)], "a int")
    bad = good.where(F.assert_true(F.col("a") < 0).isNull())
    log, one, two = f"{tmp_path}/log", f"{tmp_path}/one", f"{tmp_path}/two"
    before, work = list(session._written), f"{session.work_dir(spark).removeprefix('file:')}/remap"
    there = set(os.listdir(work)) if os.path.isdir(work) else set()
    jobs = [(1, _spec(good, "one", ids=True), one), (2, _spec(bad, "two", clear="append"), two), (3, _spec(good, "two", clear="append"), two),
            (4, _spec(bad, "two", clear="append"), two), (5, _spec(good, "none", regions={"a": "b"}, clear="append"), two)]
    results = run_batch(spark, jobs, log_path=log, run_at="2026-01-01 00:00:00")
    assert [r.status for r in results] == ["success", "error", "success", "error", "error"]
    history = read_records(spark, f"{log}/history", HISTORY).orderBy("id").collect()
    assert [(r["stmt_id"], r["status"]) for r in history] == list(enumerate((r.status for r in results), start=1))
    assert spark.read.parquet(two).count() == 2 and spark.read.parquet(one).count() == 2
    assert not glob.glob(f"{tmp_path}/*__stage_*") and session._written == before
    assert not os.path.isdir(work) or set(os.listdir(work)) <= there


def test_several_targets_all_or_none(spark, tmp_path):
    good = spark.createDataFrame([(1,)], "a int")
    bad = good.where(F.assert_true(F.col("a") < 0).isNull())
    steps = [("x", f"{tmp_path}/x", good), ("skipped", f"{tmp_path}/s", None), ("y", f"{tmp_path}/y", bad)]
    results = loads.multi_target_load(steps, job="j")
    assert [(r.target_table, r.status) for r in results] == [("x", "error"), ("y", "error")] and "y failed" in results[0].message
    assert os.listdir(tmp_path) == []
    assert [r.insert_rows for r in loads.multi_target_load(steps[:1] * 2, job="j")] == [1, 1]
    assert spark.read.parquet(f"{tmp_path}/x").count() == 2


def test_statements_on_one_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string").write.parquet(path)
    more = spark.createDataFrame([(4, "d")], "k int, v string")
    steps = [loads.append_step(more), loads.update_step(F.col("k") == 4, {"v": F.lit("e")}), loads.delete_step(F.col("v") == "b"),
             loads.merge_step(more.withColumn("k", F.lit(1)), key="k", source_key="k", assign={"v": "v"})]
    done = loads.multi_statement_load(spark, path, steps, job="j", table="t")
    assert (done.status, done.insert_rows) == ("success", 4)
    assert rows(spark.read.parquet(path)) == [(1, "d"), (3, None), (4, "e")]
    failing = [loads.delete_step(F.col("k") == 1), loads.update_step(F.assert_true(F.col("k") < 0).isNull(), {"v": F.lit("z")})]
    assert loads.multi_statement_load(spark, path, failing, job="j", table="t").status == "error"
    assert rows(spark.read.parquet(path)) == [(1, "d"), (3, None), (4, "e")]
    assert loads.multi_statement_load(spark, f"{tmp_path}/missing", steps, job="j", table="t").status == "error"


def test_a_cluster_must_name_the_shared_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.work_dir(Cluster)


def test_listing_columns_reads_no_data(spark):
    never = spark.createDataFrame([(1, "x")], "a int, b string").where(F.assert_true(F.lit(False)).isNull())
    got = column_catalog({"t": never})
    assert [tuple(r) for r in got.collect()] == [("t", "a", "int", None, None, 1), ("t", "b", "string", None, None, 2)]


def test_insert_if_absent_still_numbers_on(spark):
    have = spark.createDataFrame([(7, "a")], "id int, name string")
    new = spark.createDataFrame([("a",), ("c",), ("b",)], "name string")
    assert rows(insert_if_absent(have, new, match="name").select("id", "name")) == [(8, "b"), (9, "c")]
