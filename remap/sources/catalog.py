"""Table and column catalogs: text snapshots and measured schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def explode_lines(lines: DataFrame) -> DataFrame:
    """``table: c1, c2`` lines to ``(table_name, column_id, column_name)``.

    Lines without a colon and blank names are skipped; positions are those of
    the names kept.
    """
    parts = F.split(F.trim("value"), ":", 2)
    named = lines.where(F.contains("value", F.lit(":"))).select(
        F.trim(parts[0]).alias("table_name"), parts[1].alias("rest")
    )
    names = F.filter(
        F.transform(F.split("rest", ","), lambda n: F.trim(n)), lambda n: n != ""
    )
    out = named.select("table_name", F.posexplode(names).alias("p", "column_name"))
    return out.select("table_name", (F.col("p") + 1).cast("bigint").alias("column_id"), "column_name")


def collapse_lines(columns: DataFrame) -> DataFrame:
    """Inverse of :func:`explode_lines`: one ``value`` line per table."""
    grouped = columns.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("column_id", "column_name"))).alias("cols")
    )
    names = F.array_join(F.transform("cols", lambda c: c["column_name"]), ", ")
    return grouped.select(F.concat(F.col("table_name"), F.lit(": "), names).alias("value"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return explode_lines(spark.read.text(path))


def write_snapshot(columns: DataFrame, path: str, mode: str = "error") -> None:
    collapse_lines(columns).write.mode(mode).text(path)


def list_tables(names: list[str], pattern: str | None = None) -> list[str]:
    """Table names in order; an optional part of the name, in any letter case."""
    part = (pattern or "").strip().upper()
    return sorted(n for n in names if part in n.upper())


def column_catalog(
    tables: dict[str, DataFrame], pattern: str | None = None, *, measure: bool = False
) -> DataFrame:
    """Columns of each table with type, length and nullability, in order.

    Names, types and positions come from the schemas alone; no data is read.  Files
    declare neither a length nor NOT NULL, so these stay NULL unless ``measure`` asks
    for them: one pass per table then gives the longest text in bytes and whether NULLs
    occur.
    """
    names = list_tables(list(tables), pattern)
    if measure:
        return reduce(DataFrame.unionByName, [_one_table(n, tables[n]) for n in names])
    rows = [
        (n, f.name, f.dataType.simpleString(), None, None, i)
        for n in names
        for i, f in enumerate(tables[n].schema.fields, start=1)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        rows,
        "table_name string, column_name string, data_type string, data_length bigint, "
        "nullable string, column_id bigint",
    )


def _one_table(name: str, df: DataFrame) -> DataFrame:
    aggs = []
    for i, field in enumerate(df.schema.fields):
        longest = (
            F.max(F.octet_length(F.col(field.name)))
            if isinstance(field.dataType, T.StringType)
            else F.lit(None)
        )
        aggs.append(longest.cast("bigint").alias(f"l{i}"))
        aggs.append((F.count_if(F.col(field.name).isNull()) > 0).alias(f"n{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f"l{i}").alias("data_length"),
                F.when(F.col(f"n{i}"), "Y").otherwise("N").alias("nullable"),
                F.lit(i + 1).cast("bigint").alias("column_id"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return df.agg(*aggs).select(F.lit(name).alias("table_name"), F.inline(rows))
