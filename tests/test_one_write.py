"""Ids in a stated order with the full width written once, by the load itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import remap.operators.numbering as numbering
from remap.session import new_path
from remap.sinks.loads import reload_full


def test_full_width_is_written_once(spark, monkeypatch):
    written = []
    real = numbering.materialize

    def record(df, label):
        written.append(sorted(df.columns))
        return real(df, label)

    monkeypatch.setattr(numbering, "materialize", record)
    rows = [(i * 7 % 1000, "x" * 500, i % 3) for i in range(1000)]
    wide = spark.createDataFrame(rows, "no long, text string, grp int")
    path = new_path(spark, "one-write")
    result = reload_full(spark, wide, path, job="j", table="t", id_order=[F.col("no").asc()], id_key=["no"])
    assert result.status == "success" and result.insert_rows == 1000
    assert written and all("text" not in cols for cols in written)  # only the narrow rows were numbered
    got = spark.read.parquet(path)
    expected = wide.withColumn("id", F.row_number().over(Window.orderBy("no")).cast("bigint"))
    assert sorted(map(tuple, got.select("id", "no", "text", "grp").collect())) == sorted(
        map(tuple, expected.select("id", "no", "text", "grp").collect()))


def test_ranges_follow_the_measured_key_bytes(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RANGE_BYTES", 1000)
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    assert numbering._ranges(df, ["k"]) > 50
    monkeypatch.setattr(numbering, "RANGE_BYTES", 1 << 30)
    assert numbering._ranges(df, ["k"]) == 1
