"""Joins with unusual keys: null-tolerant, composite, one-row, fan-out, computed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    *,
    tolerant: list[tuple[str, str]],
    strict: list[tuple[str, str]] = (),
    how: str = "inner",
) -> DataFrame:
    """Join on many columns where NULL meets NULL.

    ``tolerant`` pairs use ``<=>``, so no sentinel can collide with real data;
    ``strict`` pairs use ``=`` and never match on NULL.  Both kinds stay
    equi-join keys in the plan.  A hash over all columns leads the keys, so
    rows are sorted by one number and the wide comparison runs only on ties.
    """
    pairs = [*tolerant, *strict]
    terms = [left[a].eqNullSafe(right[b]) for a, b in tolerant]
    terms += [left[a] == right[b] for a, b in strict]
    if len(pairs) > 1 and all(left.schema[a].dataType == right.schema[b].dataType for a, b in pairs):
        mine, theirs = [left[a] for a, _ in pairs], [right[b] for _, b in pairs]
        terms.insert(0, F.xxhash64(*mine) == F.xxhash64(*theirs))
    return left.join(right, reduce(lambda a, b: a & b, terms), how)


def composite_join(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str | Column]], how: str = "left"
) -> DataFrame:
    """Equi-join on several columns; right-hand keys are dropped.

    Pass a right side that was grouped by the keys through ``sizing.settled``.
    """
    names = [f"__c{i}" for i in range(len(keys))]
    side = right
    for name, (_, r) in zip(names, keys):
        side = side.withColumn(name, F.col(r) if isinstance(r, str) else r)
    on = reduce(lambda a, b: a & b, [left[l] == side[n] for n, (l, _) in zip(names, keys)])
    return left.join(side, on, how).drop(*names)


def with_one_row(df: DataFrame, other: DataFrame, *, order: list[Column], prefix: str) -> DataFrame:
    """Add the first row of ``other`` to every row of ``df``.

    An empty ``other`` leaves NULLs, so no row of ``df`` is lost.  The row is
    a scalar subquery (top-1, then one value), not a join.
    """
    one = other.orderBy(*order).limit(1).select(F.struct(*other.columns).alias("one"))
    packed = df.withColumn("__one", one.scalar())
    added = [F.col("__one")[c].alias(f"{prefix}{c}") for c in other.columns]
    return packed.select(*df.columns, *added)


def with_scalar(df: DataFrame, name: str, value: DataFrame) -> DataFrame:
    """Add the single value of a one-row, one-column frame to every row."""
    return df.withColumn(name, value.scalar())


def top_value(df: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """One-row frame with ``column`` of the first row in ``order``."""
    return df.orderBy(*order).limit(1).select(column)


def join_on_key(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: str, how: str = "inner"
) -> DataFrame:
    """Join on a computed left key; the key column is not kept."""
    keyed = left.withColumn("__key", left_key)
    return keyed.join(right, keyed["__key"] == right[right_key], how).drop("__key")


def repeated_keys(df: DataFrame, keys: list[str | Column], output: str = "n") -> DataFrame:
    """Keys that occur more than once, with their row count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > 1).withColumnRenamed("__n", output)


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Raise where a key repeats; stops at the first one found."""
    if repeated_keys(df, keys, "__rows").limit(1).count():
        raise ValueError(f"{what}: key {keys} is not unique")
