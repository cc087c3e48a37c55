"""Operators over delimited code lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remap.functions.lists import bracketed, split_codes, split_raw
from remap.functions.text import empty_to_null
from remap.operators.lookup import CodeDim
from remap.operators.sizing import DEFAULT_LIMIT, BroadcastLimit, settled

# A code table up to this many codes and bytes is folded into the plan as one constant.
FOLD_ROWS = 2_000
FOLD_BYTES = 256 * 1024
_BUCKET_ROWS = 8


def explode_codes(
    df: DataFrame, column: str, *, keep: list[str], delimiters: str = ";", blank: str = "skip"
) -> DataFrame:
    """One row per code: ``keep`` columns, 1-based ``position``, ``code``."""
    tokens = split_codes(column, delimiters, blank=blank)
    out = df.select(*keep, F.posexplode(tokens).alias("__pos", "code"))
    return out.select(*keep, (F.col("__pos") + 1).cast("bigint").alias("position"), "code")


def explode_rows(
    df: DataFrame, column: str, *, output: str, delimiters: str = ";", trim: bool = False
) -> DataFrame:
    """Multiply each row by its codes; a row without codes stays once."""
    tokens = split_codes(column, delimiters, trim=trim, blank="keep")
    return df.select(*df.columns, F.explode_outer(tokens).alias(output))


def codes_to_ids(
    df: DataFrame,
    column: str,
    dim: CodeDim,
    *,
    output: str,
    value: str = "id",
    delimiters: str = ";",
    blank: str = "skip",
    form: str = "bare",
    by_id: bool = False,
    trim: bool = True,
    fold_rows: int = FOLD_ROWS,
    limit: BroadcastLimit = DEFAULT_LIMIT,
) -> DataFrame:
    """Replace a code list by the list of ids, in list order.

    Unknown codes vanish.  ``form`` is ``bare`` (no id: NULL) or ``bracketed``
    (no id: ``[]``).  ``by_id`` gives distinct ids in ascending order and NULL
    where nothing matched.

    ``output`` may name a column that exists; it is replaced where it stands.

    A code table of at most ``fold_rows`` codes becomes one constant and each
    row is translated on its own, with no shuffle at all (for values that JSON
    text holds exactly: whole numbers, text, booleans).  With a larger one
    the *distinct* lists are translated (exploded, joined, gathered per list
    text) and joined back by list text: copies of a list, however many, cost
    one translation, and no group outgrows the list it came from.
    """
    def tokens(c: str) -> Column:
        return split_codes(c, delimiters, trim=trim, blank=blank)

    exact = isinstance(dim.frame.schema[value].dataType, (T.IntegralType, T.StringType, T.BooleanType))
    if exact and dim.rows <= fold_rows and dim.size <= FOLD_BYTES and dim.duplicates != "all":
        # Blank tokens meet no code, so trimmed ones need no filter of their own.
        plain = (trim and blank != "stop") or blank == "keep"
        pieces = split_raw(column, delimiters) if plain else tokens(column)
        look = _constant_reader(dim, value)
        ids = F.transform(pieces, lambda t: look(F.trim(t) if trim else t))
        return df.withColumn(output, _render(ids, form, by_id))

    lists = df.select(F.col(column).alias("__list")).where(F.col("__list").isNotNull()).distinct()
    codes = lists.select("__list", F.posexplode(tokens("__list")).alias("__pos", "__token"))
    side = dim.side().select(F.col("__code"), F.col(value).alias("__id"))
    found = codes.join(side, dim.probe("__token") == side["__code"])
    translated = found.groupBy("__list").agg(
        F.array_sort(F.collect_list(F.struct("__pos", "__id"))).alias("__found")
    )
    translated = translated.select("__list", F.transform("__found", lambda p: p["__id"]).alias("__ids"))
    translated = settled(translated, "lists", limit)
    joined = df.join(translated, df[column] == translated["__list"], "left")
    text = _render(F.col("__ids"), form, by_id).alias(output)
    kept = [text if c == output else df[c] for c in df.columns]
    return joined.select(*kept, *([] if output in df.columns else [text]))


def _render(ids: Column, form: str, by_id: bool) -> Column:
    """Text of an id array; NULL ids are left out."""
    if by_id:
        ids = F.array_sort(F.array_distinct(ids))
    text = empty_to_null(F.array_join(ids.cast("array<string>"), ","))
    if by_id:
        return F.when(text.isNotNull(), bracketed(text))
    if form == "bracketed":
        return bracketed(text)
    if form == "bare":
        return text
    raise ValueError(f"unknown list form: {form}")


def _constant_reader(dim: CodeDim, value: str):
    """Function from a token to its id over a code table held as a constant.

    A Spark map is searched linearly, so the codes are spread by hash over an
    array of small maps: one array access, then a handful of comparisons.  The
    table is at most ``fold_rows`` codes long, so it may pass the driver.
    """
    buckets = max(1, dim.rows // _BUCKET_ROWS)
    table = dim.table()

    def bucket(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    rows = table.select(bucket(F.col("__code")), "__code", value).collect()
    maps: list[dict] = [{} for _ in range(buckets)]
    for b, code, v in rows:
        maps[b][code] = v
    schema = T.ArrayType(T.MapType(T.StringType(), table.schema[value].dataType))
    constant = F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), schema)
    return lambda t: F.try_element_at(F.get(constant, bucket(dim.probe(t))), dim.probe(t))
