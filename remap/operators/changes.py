"""Row-changing operators, written as whole-frame rewrites.

Parquet tables take no MERGE, UPDATE or DELETE, so each operator returns the
table as it should look afterwards; the sinks stage and swap it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remap.operators.joins import require_unique
from remap.operators.numbering import assign_ids
from remap.operators.sizing import DEFAULT_LIMIT, BroadcastLimit, settled


def merge_update(
    target: DataFrame, source: DataFrame, *, key: str, source_key: str, assign: dict[str, str]
) -> DataFrame:
    """MERGE with only a matched branch: overwrite ``assign`` columns on a match.

    ``assign`` maps target column to source column.  A matched row takes the
    source value even where it is NULL.  A source that names one target row
    twice is refused, as MERGE refuses it; NULL keys and keys without a target
    row match nothing and may repeat.
    """
    keys = settled(target.select(F.col(key).alias("__at")).where("__at IS NOT NULL").distinct(), "merge-keys")
    source = source.join(keys, source[source_key] == keys["__at"], "left_semi")
    require_unique(source, [source_key], "merge source")
    side = source.select(
        F.col(source_key).alias("__key"),
        *[F.col(s).alias(f"__new_{t}") for t, s in assign.items()],
        F.lit(True).alias("__hit"),
    )
    joined = target.join(side, target[key] == side["__key"], "left")
    columns = [
        F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(target[c]).alias(c)
        if c in assign
        else target[c]
        for c in target.columns
    ]
    return joined.select(*columns)


def update_where(df: DataFrame, condition: Column, assign: dict[str, Column]) -> DataFrame:
    """UPDATE .. SET .. WHERE: rows outside the condition stay as they are."""
    return df.withColumns(
        {c: F.when(condition, v).otherwise(F.col(c)) for c, v in assign.items()}
    )


def insert_if_absent(
    existing: DataFrame,
    candidates: DataFrame,
    *,
    match: str,
    id_column: str = "id",
    order: list[Column] | None = None,
) -> DataFrame:
    """Candidates not yet present, with ids that continue after the largest one.

    Returns only the new rows, ready to append.  The largest id is a scalar
    subquery (0 on an empty table) and the new rows are numbered without a
    one-task window.
    """
    names = settled(existing.select(F.col(match).alias("__seen")).distinct(), "seen")
    fresh = candidates.join(names, candidates[match] == names["__seen"], "left_anti")
    largest = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("m"))
    return assign_ids(
        fresh,
        order or [F.col(match).asc_nulls_last()],
        output=id_column,
        start=largest.scalar() + 1,
    )


def delete_by_ids(
    df: DataFrame, ids: DataFrame, *, key: str, id_column: str = "id",
    limit: BroadcastLimit = DEFAULT_LIMIT,
) -> DataFrame:
    """Rows whose key is not in the id set."""
    drop = settled(ids.select(F.col(id_column).alias("__id")).distinct(), "ids", limit)
    return df.join(drop, df[key] == drop["__id"], "left_anti")


def update_by_key(df: DataFrame, *, key: str, value, assign: dict[str, Column]) -> DataFrame:
    """Change the one row with this key; an unknown key is an error."""
    if not df.where(F.col(key) == F.lit(value)).limit(1).count():
        raise KeyError(f"no row with {key} = {value!r}")
    return update_where(df, F.col(key) == F.lit(value), assign)


def next_id(df: DataFrame, id_column: str = "id") -> DataFrame:
    """One row: the largest id plus one, 1 on an empty table."""
    return df.agg((F.coalesce(F.max(id_column), F.lit(0)) + 1).cast("bigint").alias("next_id"))
