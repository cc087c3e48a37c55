"""Purge and load order from a (child, parent) dependency table.

A table's *level* is 0 when no table depends on it, else one more than its highest
child's: purging level by level, children go before their parents, and loading the
levels in reverse puts parents first.  The levels are found step by step in Spark: a
table joins the next level once all its children are placed.  When a step places
nothing while tables remain, they lie on or above a cycle, and the error names them.

A table that references itself (a self-join key) does not block its own purge; that
edge is ignored.  NULL names are ignored; a child with a NULL parent is still placed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remap.session import materialize
from remap.sinks.loads import purge_ordered


class DependencyCycle(ValueError):
    """The dependencies hold a cycle; ``tables`` are those left unplaced."""

    def __init__(self, tables: list[str]):
        super().__init__("dependency cycle among: " + ", ".join(tables))
        self.tables = tables


def dependency_levels(deps: DataFrame, *, child: str = "child", parent: str = "parent") -> DataFrame:
    """(table_name, level) for every table named in ``deps``."""
    edges = deps.select(F.col(child).alias("c"), F.col(parent).alias("p"))
    tables = edges.select(F.col("c").alias("t")).unionByName(edges.select(F.col("p").alias("t")))
    tables = materialize(tables.where("t IS NOT NULL").distinct(), "dep-tables")
    edges = materialize(edges.where("c IS NOT NULL AND p IS NOT NULL AND c <> p").distinct(), "dep-edges")
    placed = tables.join(edges, tables["t"] == edges["p"], "left_anti").select("t", F.lit(0).alias("level"))
    placed = materialize(placed, "dep-levels")
    total, level = tables.count(), 0
    while placed.count() < total:
        level += 1
        waiting = tables.join(placed, "t", "left_anti")
        blocked = edges.join(placed, edges["c"] == placed["t"], "left_anti").select(F.col("p").alias("t"))
        fresh = waiting.join(blocked, "t", "left_anti")
        if fresh.limit(1).count() == 0:
            raise DependencyCycle(sorted(r["t"] for r in waiting.collect()))
        placed = materialize(placed.unionByName(fresh.select("t", F.lit(level).alias("level"))), "dep-levels")
    return placed.select(F.col("t").alias("table_name"), F.col("level").cast("int").alias("level"))


def purge_by_dependency(spark: SparkSession, deps: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Empty the tables of ``paths`` level by level, each level as one step.

    Returns (level, target_table, rows_deleted); tables of ``deps`` without a path are
    skipped, tables of ``paths`` absent from ``deps`` are purged at level 0.
    """
    levels = {r["table_name"]: r["level"] for r in dependency_levels(deps).collect()}
    steps: dict[int, list[str]] = {}
    for name in paths:
        steps.setdefault(levels.get(name, 0), []).append(name)
    rows = []
    for level in sorted(steps):
        names = sorted(steps[level])
        done = purge_ordered(spark, [(n, paths[n]) for n in names]).collect()
        rows += [(level, r["target_table"], r["rows_deleted"]) for r in done]
    return spark.createDataFrame(rows, "level int, target_table string, rows_deleted bigint")
