"""JSON objects in text: notes per item, extra data in the activity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_json(df: DataFrame, column: str, *, keep: list[str]) -> DataFrame:
    """One row per key of a JSON object; text that is no object gives no row."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.select(*keep, F.explode(parsed).alias("key", "value"))


def pack_json(df: DataFrame, *, keep: list[str], key: str = "key", value: str = "value",
              output: str = "meta") -> DataFrame:
    """Inverse of :func:`explode_json`: one JSON object per ``keep`` group."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    packed = df.groupBy(*keep).agg(entries.alias("__e"))
    return packed.select(*keep, F.to_json(F.map_from_entries("__e")).alias(output))


def set_note(notes: DataFrame, name: str, note: str) -> DataFrame:
    """Put, replace or (with a blank note) drop the note of one item."""
    rest = notes.where(F.col("name") != name)
    if not note.strip():
        return rest
    spark = notes.sparkSession
    return rest.unionByName(spark.createDataFrame([(name, note.strip())], "name string, note string"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(name, note) of a notes file, which is one JSON object; anything else has no note."""
    whole = spark.read.text(path, wholetext=True)
    return explode_json(whole, "value", keep=[]).select(F.col("key").alias("name"), F.col("value").alias("note"))


def write_notes(notes: DataFrame, path: str, mode: str = "error") -> None:
    """Write the notes as one JSON object.

    The format is a single object, so the notes (a line or two per item of a small
    catalog) meet in one row.
    """
    entries = notes.select(F.lit(0).alias("file"), "name", "note")
    packed = pack_json(entries, keep=["file"], key="name", value="note", output="value")
    packed.select("value").coalesce(1).write.mode(mode).text(path)
