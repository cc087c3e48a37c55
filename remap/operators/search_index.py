"""Keyword search over logs through a trigram posting table.

``index_texts`` writes one posting row (gram, id, column) per distinct three-character
piece of each lower-cased text, range-partitioned and sorted by gram and id, so
Parquet's row-group statistics let a lookup of a few grams skip the rest, and a gram
that every text holds spreads over many tasks and files.  ``add_postings``
appends the postings of rows above a high-water id: the index grows with the logs
without reading old rows again.

A search takes the keyword's trigrams, keeps the (id, column) postings that hold all
of them, and verifies only those rows against the keyword itself, since trigrams in
some order are not yet the keyword.  The candidates are found once and written down.
The rows are read by id: a short candidate list goes into the scan as a pushed filter,
a long one is joined.  A keyword of fewer than
three characters has no trigram and is searched by a scan; a blank one keeps all rows.
Case is ignored as ``lower`` does it; accents count as written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remap.operators.reports import search
from remap.session import materialize

GRAM = 3
_GRAMS = rf"(?s)(?=({'.' * GRAM}))."  # every run of GRAM characters, overlaps included
PUSHED_IDS = 10_000  # candidate ids pushed into the scan; more are joined


def _texts(column: str):
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def postings(df: DataFrame, *, id_col: str, columns: list[str]) -> DataFrame:
    """(gram, id, col) for every distinct trigram of every column's lower-cased text."""
    parts = []
    for c in columns:
        text = _texts(c)
        grams = F.array_distinct(F.regexp_extract_all(text, F.lit(_GRAMS), F.lit(1)))
        parts.append(df.select(F.explode(grams).alias("gram"), F.col(id_col).alias("id"), F.lit(c).alias("col")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def index_texts(df: DataFrame, path: str, *, id_col: str, columns: list[str], mode: str = "overwrite") -> None:
    """Write the postings of ``df`` at ``path``, sorted by gram and id."""
    rows = postings(df, id_col=id_col, columns=columns)
    rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode(mode).parquet(path)


def add_postings(df: DataFrame, path: str, *, id_col: str, columns: list[str], above: int) -> None:
    """Append the postings of the rows whose id is above the high-water mark ``above``."""
    index_texts(df.where(F.col(id_col) > above), path, id_col=id_col, columns=columns, mode="append")


def search_indexed(
    spark: SparkSession, path: str, df: DataFrame, keyword: str, *, id_col: str, columns: list[str]
) -> DataFrame:
    """Rows of ``df`` where ``keyword`` occurs in one of ``columns``, found through the postings."""
    needle = keyword.strip().lower()
    if len(needle) < GRAM:
        return search(df, keyword, columns)
    grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    # A repeated posting can only add a candidate, so counting needs no distinct; dealt
    # by id, the postings of a row meet in one exchange.
    held = spark.read.parquet(path).where(F.col("gram").isin(grams)).repartition("id")
    found = held.groupBy("id", "col").agg(F.count("*").alias("n")).where(F.col("n") >= len(grams))
    ids = materialize(found.select("id").distinct(), "candidates")
    few = ids.limit(PUSHED_IDS + 1).collect()
    if len(few) <= PUSHED_IDS:
        rows = df.where(F.col(id_col).isin([r["id"] for r in few]))
    else:
        rows = df.join(ids.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left_semi")
    hit = F.lit(False)
    for c in columns:
        hit = hit | _texts(c).contains(needle)
    return rows.where(hit)
