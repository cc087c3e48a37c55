"""Small helpers shared by the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def values(spark, texts: list, column: Column) -> list:
    """Evaluate a column over one text column ``x``, in input order."""
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
