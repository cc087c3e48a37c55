"""Reloads published by pointer: readable at every failure point, no rename."""

from __future__ import annotations

import uuid

import pytest

import remap.sinks.files as files
from remap.session import new_path
from remap.sinks.publish import location, publish, versions


@pytest.fixture
def no_rename(monkeypatch):
    def refuse(*_):
        raise AssertionError("rename")

    monkeypatch.setattr(files, "_rename", refuse)


def frame(spark, n, tag="a"):
    return spark.createDataFrame([(i, f"{tag}{i}") for i in range(n)], "k long, v string")


def rows(spark, name):
    return sorted(map(tuple, spark.table(name).collect()))


def test_pointer_moves_and_old_versions_go(spark, no_rename):
    name, root = f"pub_{uuid.uuid4().hex[:8]}", new_path(spark, "pub")
    assert publish(spark, frame(spark, 3), name, root, job="j", table="t").status == "success"
    first = location(spark, name)
    result = publish(spark, frame(spark, 5, "b"), name, root, job="j", table="t")
    assert (result.status, result.delete_rows, result.insert_rows) == ("success", 3, 5)
    assert rows(spark, name) == sorted((i, f"b{i}") for i in range(5))
    assert len(versions(spark, root)) == 2 and first.endswith(versions(spark, root)[0].rpartition("/")[2])
    publish(spark, frame(spark, 2, "c"), name, root, job="j", table="t")
    assert len(versions(spark, root)) == 2 and not any(first.endswith(v.rpartition("/")[2]) for v in versions(spark, root))


@pytest.mark.parametrize("stop", ["build", "write"])
def test_failure_before_the_statement_keeps_the_old_rows(spark, no_rename, stop):
    name, root = f"pub_{uuid.uuid4().hex[:8]}", new_path(spark, "pub")
    publish(spark, frame(spark, 3), name, root, job="j", table="t")

    def broken():
        raise ValueError("source down")

    build = broken if stop == "build" else frame(spark, 4, "x")
    result = publish(spark, build, name, root, job="j", table="t", _stop_after=None if stop == "build" else "write")
    assert result.status == "error"
    assert rows(spark, name) == sorted((i, f"a{i}") for i in range(3))
    publish(spark, frame(spark, 1, "z"), name, root, job="j", table="t")
    assert len(versions(spark, root)) == 2  # the unfinished version went with the sweep


def test_failure_after_the_statement_reads_the_new_rows(spark, no_rename):
    name, root = f"pub_{uuid.uuid4().hex[:8]}", new_path(spark, "pub")
    publish(spark, frame(spark, 3), name, root, job="j", table="t")
    assert publish(spark, frame(spark, 2, "n"), name, root, job="j", table="t", _stop_after="point").status == "error"
    assert rows(spark, name) == [(0, "n0"), (1, "n1")]


def test_new_schema_recreates_the_table(spark, no_rename):
    name, root = f"pub_{uuid.uuid4().hex[:8]}", new_path(spark, "pub")
    publish(spark, frame(spark, 2), name, root, job="j", table="t")
    other = spark.createDataFrame([(1.5,)], "x double")
    assert publish(spark, other, name, root, job="j", table="t").status == "success"
    assert spark.table(name).columns == ["x"]
