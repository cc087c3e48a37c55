"""Levels from a dependency table, cycles named, purges one level at a time."""

from __future__ import annotations

import pytest

from remap.plans.dependencies import DependencyCycle, dependency_levels, purge_by_dependency
from remap.session import new_path


def levels(spark, pairs):
    deps = spark.createDataFrame(pairs, "child string, parent string")
    return {r.table_name: r.level for r in dependency_levels(deps).collect()}


def test_levels_take_the_longest_way(spark):
    got = levels(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("c", "e"), ("s", "s"), ("x", None)])
    assert got == {"a": 0, "d": 0, "s": 0, "x": 0, "b": 1, "c": 2, "e": 3}


def test_a_cycle_is_named(spark):
    with pytest.raises(DependencyCycle) as err:
        levels(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("z", "a"), ("a", "top")])
    assert {"a", "b", "c"} <= set(err.value.tables) and "z" not in err.value.tables


def test_purge_empties_children_first(spark):
    path = new_path(spark, "deps")
    for name, n in (("parent", 3), ("child", 5)):
        spark.range(n).write.parquet(f"{path}/{name}")
    deps = spark.createDataFrame([("child", "parent")], "child string, parent string")
    done = purge_by_dependency(spark, deps, {"parent": f"{path}/parent", "child": f"{path}/child"}).collect()
    assert [tuple(r) for r in done] == [(0, "child", 5), (1, "parent", 3)]
    assert spark.read.parquet(f"{path}/child").count() == 0
