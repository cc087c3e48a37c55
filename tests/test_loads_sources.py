from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from remap.plans.batch import run_batch
from remap.plans.mapping import AuditBlock, map_columns, with_audit
from remap.plans.spec import ListLink, LoadSpec, OwnerLink, build, run
from remap.operators.crosswalk import crosswalk
from remap.operators.lookup import CodeDim, Role
from remap.session import new_path, work_dir
from remap.sinks import files, loads
from remap.sources.catalog import column_catalog, explode_lines, list_tables, read_snapshot, write_snapshot
from remap.sources.copy import copy_projected, project_positional
from remap.sources.notes import explode_json, pack_json, set_note
from remap.sources.registry import read_registry, write_registry
from remap.sources.runlog import DELETE_LEDGER, HISTORY, SCRIPT_HISTORY, read_records, write_records
from tests.helpers import rows

NOW = "2026-01-01 00:00:00"


def broken(df):
    return df.withColumn("id", F.assert_true(F.col("id") < 0))


def test_work_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert work_dir(spark) == named.rstrip("/")
    assert new_path(spark, "a") != new_path(spark, "a")


def test_reload_twice_equals_once_and_counts(spark):
    path = new_path(spark, "t")
    df = spark.range(5)
    first = loads.reload_full(spark, df, path, job="j", table="t")
    again = loads.reload_full(spark, df, path, job="j", table="t")
    assert (first.delete_rows, first.insert_rows) == (0, 5)
    assert (again.delete_rows, again.insert_rows) == (5, 5)
    assert rows(spark.read.parquet(path)) == rows(df)


def test_failing_reload_keeps_the_old_rows(spark):
    path = new_path(spark, "t")
    loads.reload_full(spark, spark.range(5), path, job="j", table="t")
    bad = loads.reload_full(spark, broken(spark.range(5)), path, job="j", table="t")
    assert bad.status == "error" and bad.delete_rows is None and bad.insert_rows is None and bad.message
    assert spark.read.parquet(path).count() == 5

    def cannot_build():
        raise ValueError("no source")

    assert loads.reload_full(spark, cannot_build, path, job="j", table="t").message == "no source"
    assert spark.read.parquet(path).count() == 5


def test_half_done_swap_is_recovered(spark):
    path = new_path(spark, "t")
    spark.range(4).write.parquet(path)
    files._rename(spark, path, f"{path}__old")
    assert files.count_rows(spark, path) == 0
    files.recover(spark, path)
    assert files.count_rows(spark, path) == 4


def test_reload_reading_its_own_target(spark):
    path = new_path(spark, "t")
    spark.range(4).write.parquet(path)
    result = loads.reload_full(
        spark, lambda: spark.read.parquet(path).where("id > 1"), path, job="j", table="t"
    )
    assert (result.delete_rows, result.insert_rows) == (4, 2)
    assert rows(spark.read.parquet(path)) == [(2,), (3,)]


def test_empty_source_truncate_and_ids(spark):
    path = new_path(spark, "t")
    spark.range(4).write.parquet(path)
    gone = loads.reload_truncate(spark, spark.range(0), path, job="j", table="t")
    assert gone.delete_rows is None and gone.insert_rows == 0
    assert spark.read.parquet(path).count() == 0
    df = spark.createDataFrame([("b",), ("a",)], "v string")
    loads.reload_full(spark, df, path, job="j", table="t", id_order=[F.col("v").asc()])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    loads.reload_full(spark, df, path, job="j", table="t", ids=True)
    assert [i for i, _ in rows(spark.read.parquet(path))] == [1, 2]


def test_append_doubles_and_multi_target_skips_blanks(spark):
    path = new_path(spark, "t")
    for _ in range(2):
        assert loads.append_load(spark.range(3), f"{path}/a", job="j", table="a").insert_rows == 3
    assert spark.read.parquet(f"{path}/a").count() == 6
    out = loads.multi_target_load(
        [("b", f"{path}/b", spark.range(2)), ("c", f"{path}/c", None), ("d", f"{path}/d", spark.range(1))], job="j"
    )
    assert [(o.target_table, o.insert_rows) for o in out] == [("b", 2), ("d", 1)]
    assert not files.exists(spark, f"{path}/c")


def test_purge_reports_zero_the_second_time(spark):
    path = new_path(spark, "t")
    spark.range(3).write.parquet(f"{path}/a")
    out = loads.purge_ordered(spark, [("a", f"{path}/a"), ("none", f"{path}/none"), ("a", f"{path}/a")])
    assert rows(out) == [(1, "a", 3), (2, "none", 0), (3, "a", 0)]
    assert spark.read.parquet(f"{path}/a").columns == ["id"]


def test_clone_is_empty_with_the_same_columns(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    clone = loads.clone_schema(spark, df, new_path(spark, "t"))
    assert clone.count() == 0 and clone.dtypes == df.dtypes


def test_mapping(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert rows(map_columns(df, [("x", "upper(s)"), ("y", F.col("n") + 1)])) == [("A", 2)]
    with pytest.raises(ValueError):
        map_columns(df, [("x", " ")])
    audit = with_audit(df, AuditBlock(NOW, creator=3)).first()
    assert str(audit["creation_time"]) == NOW and audit["creator_user_id"] == 3
    assert audit["last_modification_time"] is None and audit["is_deleted"] == 0
    assert "void" not in dict(with_audit(df, AuditBlock(NOW)).dtypes).values()


def test_positional_copy(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "n int, s string, d double")
    out = project_positional(df, ["s", "n"], ["x", "y"], "d > 2")
    assert out.columns == ["x", "y"] and rows(out) == [("b", 2)]
    with pytest.raises(ValueError):
        project_positional(df, ["s"], ["x", "y"])
    with pytest.raises(ValueError):
        project_positional(df, [], [])
    path = new_path(spark, "copy")
    assert copy_projected(df, ["s"], ["x"], path=path) == {"rows_selected": 2, "rows_inserted": 2}
    assert rows(spark.read.parquet(path)) == [("a",), ("b",)]


def test_registry_round_trip(spark):
    sql = 'SELECT "a",\n  \'b, c\' -- ""x""\nFROM t'
    df = spark.createDataFrame(
        [("1", "n", sql), (" 2 ", "", "x"), ("x3", "n", "y"), (None, "n", "z"), ("", "n", "w")],
        "id string, name string, sql_text string",
    )
    full = df
    for c in ("source_connection_name", "target_connection_name", "source_table", "target_table"):
        full = full.withColumn(c, F.lit(c))
    path = new_path(spark, "registry")
    write_registry(full, path)
    assert rows(read_registry(spark, path).select("id", "name", "sql_text")) == [(1, "n", sql), (2, "", "x")]


@pytest.mark.parametrize("shape", [HISTORY, DELETE_LEDGER, SCRIPT_HISTORY])
def test_record_round_trip(spark, shape):
    df = spark.range(1, 4)
    for c in shape.ids:
        df = df.withColumn(c, F.col("id") * 10)
    for c in shape.texts:
        df = df.withColumn(c, F.concat(F.lit(f"{c} <&> "), "id"))
    for c in shape.counts:
        df = df.withColumn(c, F.when(F.col("id") == 1, "x").when(F.col("id") == 2, "7"))
    path = new_path(spark, "xml")
    write_records(df, path, shape)
    got = {r["id"]: r.asDict() for r in read_records(spark, path, shape).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[2][shape.ids[0]] == 20 and got[3][shape.texts[0]] == f"{shape.texts[0]} <&> 3"
    for c in shape.counts:
        assert [got[i][c] for i in (1, 2, 3)] == [None, 7, None]


def test_catalog_lines(spark):
    lines = spark.createDataFrame([("t1: a, b,,c ",), ("no colon",), (" t2 :x:y",), ("t3:",)], "value string")
    assert rows(explode_lines(lines)) == [("t1", 1, "a"), ("t1", 2, "b"), ("t1", 3, "c"), ("t2", 1, "x:y")]
    path = new_path(spark, "catalog")
    write_snapshot(explode_lines(lines), path)
    assert rows(read_snapshot(spark, path)) == rows(explode_lines(lines))


def test_column_catalog(spark, measure=True):
    a = spark.createDataFrame([("Đa", 1), (None, 2)], "s string, n int")
    out = column_catalog({"beta": a, "alpha": a.select("n"), "other": a}, "A", measure=True)
    assert rows(out) == [
        ("alpha", "n", "int", None, "N", 1),
        ("beta", "n", "int", None, "N", 2),
        ("beta", "s", "string", 3, "Y", 1),
    ]
    assert list_tables(["b", "a"]) == ["a", "b"] and list_tables(["Bx", "a"], " b ") == ["Bx"]


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "bad"), (3, None)], "i int, m string")
    pairs = explode_json(df, "m", keep=["i"])
    assert rows(pairs) == [(1, "a", "1"), (1, "b", "x")]
    assert rows(pack_json(pairs, keep=["i"])) == [(1, '{"a":"1","b":"x"}')]
    notes = spark.createDataFrame([("a", "old"), ("b", "keep")], "name string, note string")
    assert rows(set_note(notes, "a", " new ")) == [("a", "new"), ("b", "keep")]
    assert rows(set_note(notes, "a", " ")) == [("b", "keep")]


@pytest.fixture(scope="module")
def spec(spark):
    old = spark.createDataFrame([("o1", "f1"), ("o2", None)], "old_id string, file_no string")
    new = spark.createDataFrame([(1, "f1")], "id bigint, file_no string")
    detail = spark.createDataFrame(
        [(1, "o1", "a", "a;b", "2 năm"), (2, "o2", "a", "b", None), (3, "o1", "zz", None, "x")],
        "d int, old_id string, code string, l string, t string",
    )
    dim = CodeDim(spark.createDataFrame([(10, "a"), (11, "b")], "id bigint, code string"))
    return LoadSpec(
        target="t",
        source=detail,
        owner=OwnerLink(crosswalk(old, new)),
        roles=[Role("code", dim, {"code_id": "id"})],
        lists=[ListLink("l", dim, "ids")],
        durations={"t": "d_"},
        columns=[(c, c) for c in ("d", "owner_id", "code_id", "ids", "d_year", "d_day")],
        audit=AuditBlock(NOW),
    )


def test_spec_builds_one_plan(spec):
    out = build(spec)
    assert out.columns == ["d", "owner_id", "code_id", "ids", "d_year", "d_day", "creation_time", "is_deleted"]
    assert rows(out.select("d", "owner_id", "code_id", "ids", "d_year")) == [
        (1, 1, 10, "10,11", 2), (3, 1, None, None, 0),
    ]


@pytest.mark.parametrize(("clear", "after"), [("delete", 2), ("truncate", 2), ("append", 4)])
def test_clear_modes(spark, spec, clear, after):
    from dataclasses import replace

    path = new_path(spark, "spec")
    one = replace(spec, clear=clear)
    assert run(spark, one, path).status == run(spark, one, path).status == "success"
    assert spark.read.parquet(path).count() == after


def test_batch_logs_every_job(spark, spec):
    from dataclasses import replace

    path = new_path(spark, "batch")
    bad = replace(spec, target="bad", where=F.assert_true(F.col("d") < 0).isNull())
    jobs = [(1, spec, f"{path}/t"), (2, bad, f"{path}/bad"), (1, spec, f"{path}/t")]
    run_batch(spark, jobs, log_path=f"{path}/log", run_at=NOW)
    stopped = run_batch(
        spark, [jobs[1], jobs[0]], log_path=f"{path}/log", run_at=NOW, stop_on_error=True
    )
    assert [r.status for r in stopped] == ["error"]
    history = read_records(spark, f"{path}/log/history", HISTORY)
    assert rows(history.select("id", "stmt_id", "status", "delete_rows", "insert_rows")) == [
        (1, 1, "success", 0, 2), (2, 2, "error", None, None), (3, 1, "success", 2, 2), (4, 2, "error", None, None),
    ]
    ledger = read_records(spark, f"{path}/log/ledger", DELETE_LEDGER)
    assert rows(ledger.select("id", "stmt_id", "rows_deleted")) == [(1, 1, 0), (2, 1, 2)]


def test_rebuild_table_replaces_and_comments(spark):
    name = new_path(spark, "map").rsplit("/", 1)[1].replace("-", "_")
    for n in (3, 2):
        out = loads.rebuild_table(spark, name, spark.range(n), new_path(spark, "map"), "it's a \\ map")
        assert out.count() == n
    details = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert details["Comment"] == "it's a \\ map"
    spark.sql(f"DROP TABLE {name}")


def test_release_removes_intermediate_tables(spark):
    from remap import session

    session.release(spark)
    kept = session.materialize(spark.range(3), "x")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert files.exists(spark, path) and session.release(spark) == 1
    assert not files.exists(spark, path) and session.release(spark) == 0
