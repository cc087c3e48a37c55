"""Two-hop key crosswalk: old owner id -> file number -> new owner id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.functions.text import empty_to_null
from remap.operators.sizing import DEFAULT_LIMIT, BroadcastLimit, settled

_MODES = ("inner", "left")


def crosswalk(
    old: DataFrame,
    new: DataFrame,
    *,
    old_id: str = "old_id",
    file_no: str = "file_no",
    new_id: str = "id",
    new_file_no: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """``(old_id, owner_id)`` for every old owner, joined on the file number.

    ``inner`` drops owners without a counterpart; ``left`` keeps them with a
    NULL id.  Only the key columns are read from either side.
    """
    if how not in _MODES:
        raise ValueError(f"unknown crosswalk mode: {how}")
    left = old.select(F.col(old_id).alias("old_id"), empty_to_null(file_no).alias("__file"))
    right = new.select(
        F.col(new_id).alias("owner_id"), empty_to_null(new_file_no or file_no).alias("__file")
    )
    return left.join(right, "__file", how).select("old_id", "owner_id")


def shared_crosswalk(owners: DataFrame, limit: BroadcastLimit = DEFAULT_LIMIT) -> DataFrame:
    """Write a crosswalk once for a batch of loads.

    Every load then reads two narrow columns instead of joining the two owner
    tables again, and joins them without a shuffle where the measured size
    allows a broadcast.
    """
    return settled(owners, "crosswalk", limit)


def attach_owner(
    detail: DataFrame,
    owners: DataFrame,
    *,
    on: str = "old_id",
    how: str = "inner",
    strategy: str | None = None,
) -> DataFrame:
    """Add ``owner_id`` to detail rows.

    ``inner`` drops details whose owner is unknown, ``left`` keeps them.  The
    owner side is unique per old id, so a hot owner only makes the detail side
    heavy, which the adaptive skew join splits for both modes.  ``strategy`` is
    a join hint such as ``shuffle_hash``; without one Spark chooses.
    """
    if how not in _MODES:
        raise ValueError(f"unknown crosswalk mode: {how}")
    keyed = owners.withColumnRenamed("old_id", "__old")
    keyed = keyed.hint(strategy) if strategy else keyed
    return detail.join(keyed, detail[on] == keyed["__old"], how).drop("__old")


def attach_owner_left_inner(
    detail: DataFrame,
    old: DataFrame,
    new: DataFrame,
    *,
    on: str = "old_id",
    file_no: str = "file_no",
    new_id: str = "id",
) -> DataFrame:
    """Left join to the old owner, then inner join on the column it brought.

    The second join rejects the NULLs the first one kept, so the result equals
    the inner crosswalk; Catalyst rewrites the outer join to an inner one.
    """
    old_side = old.select(F.col("old_id").alias("__old"), empty_to_null(file_no).alias("__file"))
    new_side = new.select(F.col(new_id).alias("owner_id"), empty_to_null(file_no).alias("__new"))
    return (
        detail.join(old_side, detail[on] == old_side["__old"], "left")
        .join(new_side, F.col("__file") == F.col("__new"), "inner")
        .drop("__old", "__file", "__new")
    )
