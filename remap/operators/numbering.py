"""Row numbers, dense ids, pages and first-row-per-key at scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remap.session import materialize

# monotonically_increasing_id() keeps the partition in the bits above 33.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated total order.

    Spark limits each key to one row inside every map task (WindowGroupLimit)
    before the shuffle, so a hot key never gathers in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def number_rows(
    df: DataFrame,
    order: list[Column] | None,
    *,
    within: list[str] | None = None,
    key: list[str] | None = None,
    output: str = "position",
) -> DataFrame:
    """1-based position of each row in a total order, without a one-task window.

    Rows are range-partitioned and sorted, tagged with their partition and row,
    and written once; the rest is a running total over one count per partition.
    ``order`` has to be total (end it with a unique column) for the numbers to
    be repeatable; ``None`` numbers the rows as they lie and skips the shuffle.
    With ``key`` the range partitions are counted from the measured bytes of the
    key (:data:`RANGE_BYTES` each); without, Spark's shuffle partitions apply.

    ``within`` restarts the count for every group; a group larger than a
    partition simply spans several.  ``key`` names unique, never-NULL columns:
    then only they and the order columns are sorted and written, and the
    positions are joined back.  That pays for wide rows read straight from a
    table; rows that are costly to compute are better written once as a whole.
    """
    groups = within or []
    sort = [F.col(g).asc_nulls_last() for g in groups] + list(order or [])
    if sort and key:
        tagged = df.repartitionByRange(_ranges(df, [*groups, *key]), *sort).sortWithinPartitions(*sort)
    else:
        tagged = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
    tagged = tagged.withColumn("__tag", F.monotonically_increasing_id())
    if key:
        tagged = tagged.select(*dict.fromkeys([*groups, *key]), "__tag")
    stored = materialize(tagged, "numbered").withColumns(
        {
            "__part": F.shiftright("__tag", _ROW_BITS),
            "__row": F.col("__tag").bitwiseAND(F.lit(_ROW_MASK)),
        }
    )
    joined, position = _group_offsets(stored, groups) if groups else _offsets(stored)
    position = position.cast("bigint").alias(output)
    if not key:
        return joined.select(*df.columns, position)
    places = joined.select(*[F.col(k).alias(f"__u{i}") for i, k in enumerate(key)], position)
    on = reduce(lambda a, b: a & b, [df[k] == places[f"__u{i}"] for i, k in enumerate(key)])
    return df.join(places, on).select(*[df[c] for c in df.columns], output)


# Bytes of sorted narrow rows (key, order columns and tag) that one range partition holds.
RANGE_BYTES = 64 << 20


def _ranges(df: DataFrame, key: list[str]) -> int:
    """Range partitions for the narrow sort, from the measured bytes of the key columns.

    The key's bytes are measured (one pass over those columns only) and doubled for
    the order columns and the tag that travel with it.
    """
    from remap.operators.sizing import measure

    _, size = measure(df.select(*key))
    return max(1, -(-2 * size // RANGE_BYTES))


def _offsets(stored: DataFrame) -> tuple[DataFrame, Column]:
    """Rows joined to the rows before their partition: one row per partition."""
    running = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"),
    )
    joined = stored.join(F.broadcast(offsets), stored["__part"] == offsets["__p"])
    return joined, F.col("__before") + F.col("__row") + 1


def _group_offsets(stored: DataFrame, groups: list[str]) -> tuple[DataFrame, Column]:
    """Rows joined to their group's earlier rows: one row per group and partition."""
    runs = stored.groupBy("__part", *groups).agg(
        F.min("__row").alias("__start"), F.count(F.lit(1)).alias("__n")
    )
    running = (
        Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.select(
        F.col("__part").alias("__p"),
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        "__start",
        F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"),
    )
    same = [stored[g].eqNullSafe(runs[f"__g{i}"]) for i, g in enumerate(groups)]
    joined = stored.join(runs, reduce(lambda a, b: a & b, same, stored["__part"] == runs["__p"]))
    return joined, F.col("__before") + F.col("__row") - F.col("__start") + 1


def assign_ids(
    df: DataFrame,
    order: list[Column] | None = None,
    *,
    key: list[str] | None = None,
    output: str = "id",
    start: int | Column = 1,
) -> DataFrame:
    """Dense surrogate ids from ``start`` on, in the stated order or in any."""
    numbered = number_rows(df, order, key=key, output="__pos")
    first = F.lit(start) if isinstance(start, int) else start
    new_id = (first + F.col("__pos") - 1).cast("bigint").alias(output)
    return numbered.select(new_id, *df.columns)


def paginate(
    df: DataFrame, order: list[Column], size: int = 20, key: list[str] | None = None
) -> DataFrame:
    """Position and page number of every row."""
    numbered = number_rows(df, order, key=key)
    page = F.ceil(F.col("position") / F.lit(size)).cast("bigint")
    return numbered.withColumn("page", page)


def priority_order(
    df: DataFrame, name: str, first: list[str], exclude_prefix: str | None = None
) -> DataFrame:
    """Named items first in the given order, all others by name."""
    if exclude_prefix:
        df = df.where(~F.col(name).startswith(exclude_prefix))
    rank = F.lit(len(first))
    for i, item in reversed(list(enumerate(first))):
        rank = F.when(F.col(name) == item, F.lit(i)).otherwise(rank)
    keep = df.columns
    numbered = number_rows(df.withColumn("__rank", rank), [F.col("__rank"), F.col(name)])
    return numbered.select(*keep, "position")


# Fixed value: the date that stands for a missing one.
NO_DATE = "1900-01-01"


def rank_by_latest(
    df: DataFrame, dates: list[str], then: list[Column], output: str = "rn"
) -> DataFrame:
    """Rank by the latest of several dates, newest first; NULL dates count 1900."""
    floor = F.lit(NO_DATE).cast("timestamp_ntz")
    latest = F.greatest(*[F.coalesce(F.col(d), floor) for d in dates])
    ranked = number_rows(
        df.withColumn("__latest", latest), [F.col("__latest").desc(), *then], output=output
    )
    return ranked.select(*df.columns, output)


def dedup_first_wins(
    df: DataFrame, keys: list[str], order: list[Column], *, output: str = "id"
) -> DataFrame:
    """First row of each key pair, renumbered 1..n in the original order."""
    return assign_ids(first_per_key(df, keys, order), order, output=output)
