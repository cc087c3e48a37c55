"""Loads that need more than one spec: master-detail, region map, scratch ids, teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remap.functions.dates import duration_parts
from remap.functions.text import after_delimiter, before_delimiter, fold_accents
from remap.operators.changes import insert_if_absent, merge_update, update_where
from remap.operators.joins import join_on_key, null_safe_join
from remap.operators.lookup import CodeDim, Role, resolve_codes
from remap.operators.numbering import assign_ids
from remap.operators.sizing import broadcast_if_small, settled


def region_map(
    old: DataFrame, new: DataFrame, *, code: str = "code", name: str = "name"
) -> DataFrame:
    """Old region to new region by name, ignoring case and accents."""
    left = old.select(
        F.col(code).alias("old_code"), F.col(name).alias("old_name"), fold_accents(name).alias("__n")
    )
    right = broadcast_if_small(
        new.select(
            F.col(code).alias("new_code"), F.col(name).alias("new_name"), fold_accents(name).alias("__n")
        )
    )
    return left.join(right, "__n", "left").drop("__n")


def scratch_id_map(
    old: DataFrame, new: DataFrame, *, old_id: str, new_id: str, business: list[str]
) -> DataFrame:
    """``(old_id, new_id)``: the smallest new id that shares the business columns.

    The new side is reduced to one row per business key before the join, so
    repeated headers cannot fan out.
    """
    firsts = settled(new.groupBy(*business).agg(F.min(new_id).alias("__new")), "firsts")
    return old.join(firsts, business).select(
        F.col(old_id).alias("old_id"), F.col("__new").alias("new_id")
    )


def master_detail(
    rows: DataFrame,
    *,
    business: list[str],
    strict: list[str],
    parent_id: str = "parent_id",
) -> tuple[DataFrame, DataFrame]:
    """Distinct parents with new ids, and every row with its parent's id.

    Rows find their parent by the business columns; NULL meets NULL except in
    the ``strict`` ones, where a NULL finds no parent and the row is left out.
    """
    order = [F.col(c).asc_nulls_last() for c in business]
    parents = assign_ids(rows.select(*business).distinct(), order, output=parent_id)
    renamed = parents.select(parent_id, *[F.col(c).alias(f"__p_{c}") for c in business])
    children = null_safe_join(
        rows,
        renamed,
        tolerant=[(c, f"__p_{c}") for c in business if c not in strict],
        strict=[(c, f"__p_{c}") for c in strict],
    )
    return parents, children.select(*rows.columns, parent_id)


def header_with_count(
    headers: DataFrame, details: DataFrame, *, key: str, detail_key: str, output: str = "n_details"
) -> DataFrame:
    """Headers with the number of their details, 0 where there is none.

    Details are counted per key first, so the wide header is never multiplied
    and a hot header shuffles one row per task.
    """
    counts = details.groupBy(F.col(detail_key).alias("__k")).agg(F.count(detail_key).alias("__n"))
    counts = settled(counts, "counts")
    joined = headers.join(counts, headers[key] == counts["__k"], "left")
    return joined.withColumn(output, F.coalesce(F.col("__n"), F.lit(0))).drop("__k", "__n")


def name_part_tokens(teams: DataFrame, *, name: str, code: str, status: str, extra: str) -> DataFrame:
    """Right-hand name parts with their smallest code and largest status.

    ``extra`` is the name that stands without a delimiter; it is left out of the
    extracted set and added as one row of its own.
    """
    part = after_delimiter(name, ",")
    aggs = [F.min(code).alias("code"), F.max(status).alias("status")]
    tokens = (
        teams.withColumn("__part", part)
        .where(F.col("__part").isNotNull() & (F.col("__part") != extra))
        .groupBy(F.col("__part").alias("name"))
        .agg(*aggs)
    )
    supplied = teams.where(F.col(name) == extra).agg(*aggs)
    return tokens.unionByName(supplied.select(F.lit(extra).alias("name"), "code", "status"))


def parent_name(name: str, extra: str) -> Column:
    """Join key of a team: the part after the comma, or the special name itself."""
    return F.when(F.col(name) == extra, F.lit(extra)).otherwise(after_delimiter(name, ","))


def split_teams(
    teams: DataFrame, parents: DataFrame, *, extra: str, name: str = "name"
) -> tuple[DataFrame, DataFrame]:
    """Build missing parents from team names and link the teams to them.

    Returns the new parents and the teams with ``parent_id`` set and the name
    cut to the part before the comma.
    """
    tokens = name_part_tokens(teams, name=name, code="code", status="status", extra=extra)
    fresh = insert_if_absent(parents, tokens, match="name")
    every = parents.select("id", "name").unionByName(fresh.select("id", "name"))
    linked = join_on_key(
        teams.select("id", name),
        every.select(F.col("id").alias("parent_id"), F.col("name").alias("__parent")),
        parent_name(name, extra),
        "__parent",
    ).select("id", "parent_id")
    merged = merge_update(
        teams.withColumn("parent_id", F.lit(None).cast("bigint")),
        linked,
        key="id",
        source_key="id",
        assign={"parent_id": "parent_id"},
    )
    cut = update_where(
        merged, F.instr(F.col(name), ",") > 0, {name: before_delimiter(name, ",")}
    )
    return fresh, cut


def duration_band(df: DataFrame, bands: DataFrame, *, title: str, output: str) -> DataFrame:
    """Band id of a duration title by its years, months and days.

    ``bands`` holds (id, title); titles are compared by value, so two spellings
    of one duration share a band.
    """
    dim = CodeDim(bands.select("id", _duration_key("title").alias("k")), code="k", duplicates="first")
    return resolve_codes(df, [Role(_duration_key(title), dim, {output: "id"})])


def _duration_key(title: str) -> Column:
    """Years, months and days as one text key; NULL for a missing title."""
    parts = duration_parts(title)
    return F.when(parts["years"].isNotNull(), F.concat_ws("/", *[parts[n] for n in ("years", "months", "days")]))
