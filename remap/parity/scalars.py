"""Projection and scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.functions import (
    balance,
    clip,
    duration_parts,
    null_safe_sum,
    oconcat,
    try_number,
    year_label,
)
from remap.parity.registry import RUN_AT, query
from remap.plans.mapping import AuditBlock, copy_code_table, map_columns, with_audit
from remap.plans.steps import duration_band


@query(
    "map_columns",
    """
    SELECT detail_id AS ref_no, old_id AS owner_ref, upper(action) AS state,
           amount_due AS amount, coalesce(amount_paid, 0) AS paid, 0 AS flag
    FROM detail_old
    """,
)
def _(t):
    return map_columns(
        t.detail_old,
        [
            ("ref_no", "detail_id"),
            ("owner_ref", "old_id"),
            ("state", "upper(action)"),
            ("amount", "amount_due"),
            ("paid", "coalesce(amount_paid, 0)"),
            ("flag", F.lit(0)),
        ],
    )


@query(
    "audit_columns",
    f"""
    SELECT detail_id, TIMESTAMP '{RUN_AT}' AS creation_time,
           CAST(1 AS bigint) AS creator_user_id, TIMESTAMP '{RUN_AT}' AS last_modification_time,
           CAST(NULL AS bigint) AS last_modifier_user_id, CAST(0 AS int) AS is_deleted,
           CAST(NULL AS bigint) AS deleter_user_id, CAST(NULL AS timestamp) AS deletion_time
    FROM detail_old
    """,
)
def _(t):
    return with_audit(t.detail_old.select("detail_id"), AuditBlock(RUN_AT, creator=1, touched=True))


@query(
    "copy_code_table",
    f"""
    SELECT code, title, CAST(1 AS int) AS status, TIMESTAMP '{RUN_AT}' AS creation_time,
           CAST(0 AS int) AS is_deleted
    FROM part_dim
    """,
)
def _(t):
    return copy_code_table(t.part_dim, code="code", title="title", run_at=RUN_AT)


@query(
    "concat_null_as_empty",
    """
    SELECT old_id, coalesce(street, '') || ', ' || coalesce(ward_name, '') AS address,
           nullif(coalesce(nullif(trim(doc_no), ''), '')
                  || CASE WHEN alt_doc_no IS NOT NULL THEN chr(10) || alt_doc_no ELSE '' END, '')
               AS doc_note
    FROM party_old
    """,
)
def _(t):
    from remap.functions import blank_to_null

    extra = F.when(F.col("alt_doc_no").isNotNull(), oconcat(F.lit("\n"), "alt_doc_no"))
    return t.party_old.select(
        "old_id",
        oconcat("street", F.lit(", "), "ward_name").alias("address"),
        oconcat(blank_to_null("doc_no"), extra).alias("doc_note"),
    )


@query(
    "status_flag",
    """
    SELECT detail_id, CAST(CASE WHEN upper(action) = 'CLOSE' THEN 0 ELSE 1 END AS int) AS is_open
    FROM detail_old
    """,
)
def _(t):
    flag = F.when(F.upper("action") == "CLOSE", F.lit(0)).otherwise(F.lit(1))
    return t.detail_old.select("detail_id", flag.alias("is_open"))


@query(
    "null_safe_sum",
    """
    SELECT detail_id, coalesce(amount_due, 0) + coalesce(amount_paid, 0) AS total FROM detail_old
    """,
)
def _(t):
    return t.detail_old.select("detail_id", null_safe_sum("amount_due", "amount_paid").alias("total"))


@query(
    "balance_due",
    "SELECT detail_id, amount_due - coalesce(amount_paid, 0) AS left_to_pay FROM detail_old",
)
def _(t):
    return t.detail_old.select("detail_id", balance("amount_due", "amount_paid").alias("left_to_pay"))


@query(
    "clip_text",
    """
    SELECT doc_id, nullif(substr(text, 1, 250), '') AS short_text,
           nullif(substr(source, 1, 3), '') AS short_source
    FROM documents
    """,
)
def _(t):
    return t.documents.select(
        "doc_id", clip("text", 250).alias("short_text"), clip("source", 3).alias("short_source")
    )


@query(
    "parse_duration",
    r"""
    SELECT detail_id,
           CASE WHEN duration_title IS NOT NULL THEN coalesce(CAST(nullif(
               regexp_extract(duration_title, '(?i)(\d+)\s*năm', 1), '') AS bigint), 0) END AS years,
           CASE WHEN duration_title IS NOT NULL THEN coalesce(CAST(nullif(
               regexp_extract(duration_title, '(?i)(\d+)\s*tháng', 1), '') AS bigint), 0) END AS months,
           CASE WHEN duration_title IS NOT NULL THEN coalesce(CAST(nullif(
               regexp_extract(duration_title, '(?i)(\d+)\s*ngày', 1), '') AS bigint), 0) END AS days
    FROM detail_old
    """,
)
def _(t):
    parts = duration_parts("duration_title")
    return t.detail_old.select("detail_id", parts.alias("d")).select("detail_id", "d.*")


_KEY = r"""coalesce(nullif(regexp_extract({c}, '(?i)(\d+)\s*năm', 1), ''), '0') || '/' ||
           coalesce(nullif(regexp_extract({c}, '(?i)(\d+)\s*tháng', 1), ''), '0') || '/' ||
           coalesce(nullif(regexp_extract({c}, '(?i)(\d+)\s*ngày', 1), ''), '0')"""


@query(
    "duration_to_band",
    f"""
    WITH bands AS (SELECT {_KEY.format(c='title')} AS k, min(id) AS id FROM band_dim
                   WHERE title IS NOT NULL GROUP BY 1)
    SELECT d.detail_id, b.id AS band_id
    FROM detail_old d LEFT JOIN bands b
      ON d.duration_title IS NOT NULL AND b.k = {_KEY.format(c='d.duration_title')}
    """,
)
def _(t):
    out = duration_band(t.detail_old, t.band_dim, title="duration_title", output="band_id")
    return out.select("detail_id", "band_id")


@query(
    "year_label",
    """
    SELECT detail_id, strftime(event_date, '%Y') AS year_text,
           'Round ' || coalesce(strftime(review_date, '%Y'), '') AS round_name,
           strftime(review_date, '%Y-%m-%d') AS review_day
    FROM detail_old
    """,
)
def _(t):
    return t.detail_old.select(
        "detail_id",
        year_label("event_date").alias("year_text"),
        year_label("review_date", "Round ").alias("round_name"),
        F.date_format("review_date", "yyyy-MM-dd").alias("review_day"),
    )


@query(
    "cast_suite",
    """
    SELECT detail_id, CAST(detail_id AS string) AS id_text,
           CAST(CAST(floor(amount_due) AS bigint) AS string) AS amount_text,
           CAST(CAST(CAST(floor(amount_due) AS bigint) AS decimal(38, 2)) AS string) AS amount_wide,
           CAST(event_date AS timestamp) AS event_ts,
           CAST(greatest(CAST(event_date AS date), DATE '1995-06-01') AS timestamp) AS not_before,
           '0001-01-01 00:00:00' AS no_time
    FROM detail_old
    """,
)
def _(t):
    whole = F.floor("amount_due").cast("bigint")
    sentinel = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return t.detail_old.select(
        "detail_id",
        F.col("detail_id").cast("string").alias("id_text"),
        whole.cast("string").alias("amount_text"),
        whole.cast("decimal(38,2)").cast("string").alias("amount_wide"),
        F.col("event_date").cast("timestamp_ntz").alias("event_ts"),
        F.greatest(F.col("event_date").cast("date"), F.lit("1995-06-01").cast("date"))
        .cast("timestamp_ntz")
        .alias("not_before"),
        F.date_format(sentinel, "yyyy-MM-dd HH:mm:ss").alias("no_time"),
    )


@query(
    "try_number",
    """
    SELECT old_id, TRY_CAST(trim(doc_no) AS bigint) AS doc_number,
           TRY_CAST(trim(region_code_old) AS bigint) AS region_number,
           TRY_CAST(trim(full_name) AS bigint) AS name_number
    FROM party_old
    """,
)
def _(t):
    return t.party_old.select(
        "old_id",
        try_number("doc_no").alias("doc_number"),
        try_number("region_code_old").alias("region_number"),
        try_number("full_name").alias("name_number"),
    )
