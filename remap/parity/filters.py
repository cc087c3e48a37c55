"""Filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.functions import (
    after_delimiter,
    blank_to_null,
    contains_any,
    empty_to_null,
    first_filled,
    has_letter,
    iso_date_text,
    slash_date,
)
from remap.parity.registry import query
from remap.plans.steps import name_part_tokens


@query(
    "filter_active",
    """
    SELECT detail_id, code_a, action FROM detail_old
    WHERE action = 'OPEN' AND code_a <> '5'
    """,
)
def _(t):
    rows = t.detail_old.where((F.col("action") == "OPEN") & (F.col("code_a") != "5"))
    return rows.select("detail_id", "code_a", "action")


@query(
    "filter_like_or",
    """
    SELECT id, name FROM team_dim
    WHERE upper(name) LIKE '%WIDGET%' OR upper(name) LIKE '%BRAND#1%'
    """,
)
def _(t):
    return t.team_dim.where(contains_any("name", ["widget", "Brand#1"])).select("id", "name")


@query(
    "filter_blank",
    """
    SELECT old_id, nullif(trim(doc_no), '') AS doc_clean FROM party_old
    WHERE nullif(trim(doc_no), '') IS NULL OR nullif(trim(street), '') IS NOT NULL
    """,
)
def _(t):
    keep = blank_to_null("doc_no").isNull() | blank_to_null("street").isNotNull()
    return t.party_old.where(keep).select("old_id", blank_to_null("doc_no").alias("doc_clean"))


@query(
    "route_by_pattern",
    r"""
    SELECT old_id,
           CASE WHEN NOT regexp_matches(d, '\p{L}') THEN d END AS number_doc,
           CASE WHEN regexp_matches(d, '\p{L}') THEN d END AS letter_doc
    FROM (SELECT old_id, coalesce(nullif(doc_no, ''), nullif(alt_doc_no, '')) AS d FROM party_old) x
    """,
)
def _(t):
    doc = first_filled("doc_no", "alt_doc_no")
    return t.party_old.select(
        "old_id",
        F.when(~has_letter(doc), doc).alias("number_doc"),
        F.when(has_letter(doc), doc).alias("letter_doc"),
    )


@query(
    "parse_date_formats",
    r"""
    SELECT detail_id,
           CASE WHEN regexp_full_match(date_text, '\d{2}/\d{2}/\d{4}')
                THEN strftime(try_strptime(date_text, '%d/%m/%Y'), '%Y-%m-%d')
                WHEN regexp_full_match(date_text, '\d{4}-\d{2}-\d{2}') THEN date_text
           END AS iso_text,
           CASE WHEN regexp_full_match(date_text, '\d{2}/\d{2}/\d{4}')
                THEN try_strptime(date_text, '%d/%m/%Y') END AS slash_ts
    FROM detail_old
    """,
)
def _(t):
    return t.detail_old.select(
        "detail_id",
        iso_date_text("date_text").alias("iso_text"),
        slash_date("date_text").alias("slash_ts"),
    )


@query(
    "split_name_parts",
    """
    WITH pieces AS (SELECT string_split(name, ',') AS piece, code, status FROM team_dim),
    parts AS (SELECT trim(array_to_string(piece[2:], ',')) AS part_name, code, status
              FROM pieces WHERE len(piece) > 1)
    SELECT part_name, min(code) AS code, max(status) AS status
    FROM parts WHERE part_name NOT IN ('', 'Unassigned') GROUP BY part_name
    """,
)
def _(t):
    part = after_delimiter("name", ",")
    rows = t.team_dim.withColumn("part_name", part).where("part_name <> 'Unassigned'")
    return rows.groupBy("part_name").agg(
        F.min("code").alias("code"), F.max("status").alias("status")
    )


@query(
    "union_tokens",
    """
    SELECT trim(split_part(name, ',', 2)) AS name, min(code) AS code, max(status) AS status
    FROM team_dim WHERE name LIKE '%,%' GROUP BY 1
    UNION ALL
    SELECT 'Unassigned', min(code), max(status) FROM team_dim WHERE name = 'Unassigned'
    """,
)
def _(t):
    return name_part_tokens(
        t.team_dim, name="name", code="code", status="status", extra="Unassigned"
    )


@query(
    "coalesce_sources",
    """
    SELECT old_id, coalesce(nullif(doc_no, ''), alt_doc_no, street) AS any_doc,
           coalesce(nullif(trim(doc_no), ''), nullif(trim(alt_doc_no), ''), 'none') AS filled_doc
    FROM party_old
    """,
)
def _(t):
    return t.party_old.select(
        "old_id",
        first_filled("doc_no", "alt_doc_no", "street").alias("any_doc"),
        F.coalesce(
            blank_to_null("doc_no"), blank_to_null("alt_doc_no"), empty_to_null(F.lit("none"))
        ).alias("filled_doc"),
    )
