"""Keyed tables: changes touch only the partitions that hold a hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.operators.changes import delete_by_ids, merge_update
from remap.session import new_path
from remap.sinks.keyed import PART, delete_partitioned, merge_partitioned, part_of, read_keyed, store_by_key


def files(spark, path):
    """Data file name and modification time per partition folder."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(PART + "="):
            inner = fs.listStatus(status.getPath())
            found[int(name.split("=")[1])] = sorted((s.getPath().getName(), s.getModificationTime()) for s in inner)
    return found


def table(spark):
    rows = [(i, f"n{i}", 0) for i in range(200)] + [(None, "no key", 0)]
    return spark.createDataFrame(rows, "id long, name string, value long")


def test_merge_rewrites_only_hit_partitions(spark):
    path = new_path(spark, "test-keyed")
    df = table(spark)
    assert store_by_key(df, path, key="id", parts=8) == 8
    before = files(spark, path)
    source = spark.createDataFrame([(3, 30), (4, 40), (None, 1), (999, 2)], "k long, v long")
    hit = {r[0] for r in source.where("k IS NOT NULL").select(part_of(F.col("k"), 8)).collect()}
    assert merge_partitioned(spark, path, source, key="id", source_key="k", assign={"value": "v"}) == len(hit)
    after = files(spark, path)
    assert set(after) == set(before)
    for p in before:
        assert (after[p] == before[p]) == (p not in hit), p
    expected = merge_update(df, source, key="id", source_key="k", assign={"value": "v"})
    assert sorted(map(tuple, read_keyed(spark, path).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_delete_drops_emptied_partitions(spark):
    path = new_path(spark, "test-keyed")
    df = table(spark)
    store_by_key(df, path, key="id", parts=4)
    before = files(spark, path)
    one = df.where(part_of(F.col("id"), 4) == 1).where("id IS NOT NULL").select(F.col("id").alias("gone"))
    others = df.where("id IN (0, 1)").select(F.col("id").alias("gone"))
    ids = one.unionByName(others)
    delete_partitioned(spark, path, ids, key="id", id_column="gone")
    after = files(spark, path)
    expected = delete_by_ids(df, ids, key="id", id_column="gone")
    assert sorted(map(tuple, read_keyed(spark, path).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    hit = {r[0] for r in ids.select(part_of(F.col("gone"), 4)).collect()}
    for p in set(before) - hit:
        assert after[p] == before[p]
    if 1 in before:
        assert 1 not in after or all(r.id is None for r in spark.read.parquet(path).where(f"{PART} = 1").collect())


def test_no_hit_changes_nothing(spark):
    path = new_path(spark, "test-keyed")
    store_by_key(table(spark), path, key="id", parts=4)
    before = files(spark, path)
    empty = spark.createDataFrame([], "k long, v long")
    assert merge_partitioned(spark, path, empty, key="id", source_key="k", assign={"value": "v"}) == 0
    assert files(spark, path) == before
