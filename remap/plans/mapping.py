"""Ordered column mappings and the audit block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mapping = list[tuple[str, "Column | str"]]


def map_columns(source: DataFrame, mapping: Mapping) -> DataFrame:
    """Project ``(target, source column or expression)`` pairs in order.

    A target without a source is an error, not a placeholder.
    """
    columns = []
    for target, expression in mapping:
        if isinstance(expression, str):
            if not expression.strip():
                raise ValueError(f"target column {target!r} has no source")
            expression = F.expr(expression)
        columns.append(expression.alias(target))
    return source.select(*columns)


def read_mapping(stored: DataFrame, *, job_id: int) -> Mapping:
    """The mapping of one job from a table (job_id, column_order, source, target).

    A mapping has as many rows as its target has columns, so it may pass the driver.
    """
    rows = stored.where(F.col("job_id") == job_id).orderBy("column_order", "target")
    return [(r["target"], r["source"] or "") for r in rows.select("source", "target").collect()]


def typed_null(to: str) -> Column:
    return F.lit(None).cast(to)


@dataclass(frozen=True)
class AuditBlock:
    """The audit columns of a target row.

    ``run_at`` is given by the caller, so a rerun with the same value gives the
    same rows.  ``touched`` sets the modification time to the run time as well.
    """

    run_at: str
    creator: int | None = None
    touched: bool = False

    # The names of the audit columns.
    def columns(self) -> Mapping:
        now = F.lit(self.run_at).cast("timestamp_ntz")
        return [
            ("creation_time", now),
            ("creator_user_id", F.lit(self.creator).cast("bigint")),
            ("last_modification_time", now if self.touched else typed_null("timestamp_ntz")),
            ("last_modifier_user_id", typed_null("bigint")),
            ("is_deleted", F.lit(0).cast("int")),
            ("deleter_user_id", typed_null("bigint")),
            ("deletion_time", typed_null("timestamp_ntz")),
        ]

    def short(self) -> Mapping:
        """Only the two columns most loads write."""
        full = dict(self.columns())
        return [(c, full[c]) for c in ("creation_time", "is_deleted")]


def with_audit(df: DataFrame, audit: AuditBlock) -> DataFrame:
    return df.withColumns(dict(audit.columns()))


def copy_code_table(
    source: DataFrame, *, code: str, title: str, run_at: str, status: int = 1
) -> DataFrame:
    """Straight copy of a code table with a fixed status and the audit pair."""
    return map_columns(
        source,
        [
            ("code", F.col(code)),
            ("title", F.col(title)),
            ("status", F.lit(status).cast("int")),
            *AuditBlock(run_at).short(),
        ],
    )
