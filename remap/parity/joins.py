"""Queries for joins with unusual keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.operators.joins import (
    composite_join,
    null_safe_join,
    repeated_keys,
    top_value,
    with_one_row,
    with_scalar,
)
from remap.operators.numbering import first_per_key
from remap.operators.sizing import settled
from remap.parity.registry import query
from remap.plans.steps import header_with_count, scratch_id_map

_TOLERANT = [
    "code_a", "code_b", "code_list", "duration_title", "date_text", "review_date",
    "amount_paid", "action",
]
_STRICT = ["event_date", "note"]


@query(
    "join_null_safe",
    f"""
    WITH header AS (
        SELECT {', '.join(_TOLERANT + _STRICT)}, min(detail_id) AS header_id
        FROM detail_old GROUP BY ALL)
    SELECT d.detail_id, h.header_id
    FROM detail_old d JOIN header h ON
    {' AND '.join(f'd.{c} IS NOT DISTINCT FROM h.{c}' for c in _TOLERANT)}
    AND {' AND '.join(f'd.{c} = h.{c}' for c in _STRICT)}
    """,
)
def _(t):
    details = t.detail_old
    columns = _TOLERANT + _STRICT
    headers = details.groupBy(*[F.col(c).alias(f"h_{c}") for c in columns]).agg(
        F.min("detail_id").alias("header_id")
    )
    out = null_safe_join(
        details,
        headers,
        tolerant=[(c, f"h_{c}") for c in _TOLERANT],
        strict=[(c, f"h_{c}") for c in _STRICT],
    )
    return out.select("detail_id", "header_id")


@query(
    "join_composite",
    """
    SELECT d.detail_id, d.old_id, year(d.event_date) AS year_no, m.most
    FROM detail_old d
    LEFT JOIN (SELECT old_id, year(event_date) AS year_no, max(amount_due) AS most
               FROM detail_old WHERE action = 'OPEN' GROUP BY 1, 2) m
      ON m.old_id = d.old_id AND m.year_no = year(d.event_date)
    """,
)
def _(t):
    rows = t.detail_old.withColumn("year_no", F.year("event_date").cast("bigint"))
    money = (
        rows.where("action = 'OPEN'")
        .groupBy("old_id", "year_no")
        .agg(F.max("amount_due").alias("most"))
        .withColumnsRenamed({"old_id": "m_id", "year_no": "m_year"})
    )
    money = settled(money, "money")
    out = composite_join(rows, money, [("old_id", "m_id"), ("year_no", "m_year")])
    return out.select("detail_id", "old_id", "year_no", "most")


@query(
    "left_join_one_row",
    """
    SELECT d.detail_id, o.code AS one_code, o.name AS one_name, e.code AS none_code
    FROM detail_old d
    LEFT JOIN (SELECT * FROM team_dim ORDER BY status DESC NULLS LAST, id LIMIT 1) o ON 1 = 1
    LEFT JOIN (SELECT * FROM team_dim WHERE name IS NULL ORDER BY id LIMIT 1) e ON 1 = 1
    """,
)
def _(t):
    teams = t.team_dim.select("id", "code", "name", "status")
    order = [F.col("status").desc_nulls_last(), F.col("id").asc()]
    out = with_one_row(t.detail_old, teams, order=order, prefix="one_")
    out = with_one_row(out, teams.where("name IS NULL"), order=order, prefix="none_")
    return out.select("detail_id", "one_code", "one_name", "none_code")


@query(
    "join_fanout",
    """
    SELECT d.detail_id, d.event_date, p.kind
    FROM detail_old d
    JOIN (SELECT DISTINCT o_orderdate AS period_date, o_orderstatus AS kind FROM orders) p
      ON p.period_date = d.event_date
    """,
)
def _(t):
    # The parents are reduced to their distinct rows first: one date then meets
    # at most one parent per status, however many orders share it.
    periods = t.orders.select(
        F.col("o_orderdate").alias("period_date"), F.col("o_orderstatus").alias("kind")
    ).distinct()
    rows = t.detail_old.select("detail_id", "event_date")
    out = rows.join(periods, rows["event_date"] == periods["period_date"])
    return out.select("detail_id", "event_date", "kind")


@query(
    "check_key_unique",
    """
    SELECT lower(trim(name)) AS name_key, count(*) AS n
    FROM team_dim GROUP BY 1 HAVING count(*) > 1
    """,
)
def _(t):
    return repeated_keys(t.team_dim, [F.lower(F.trim("name")).alias("name_key")])


@query(
    "scalar_top1",
    """
    SELECT d.detail_id,
           (SELECT id FROM team_dim ORDER BY status DESC NULLS LAST, id DESC LIMIT 1) AS top_id
    FROM detail_old d
    """,
)
def _(t):
    top = top_value(t.team_dim, "id", [F.col("status").desc_nulls_last(), F.col("id").desc()])
    return with_scalar(t.detail_old.select("detail_id"), "top_id", top)


@query(
    "first_row_per_key",
    """
    SELECT p.old_id, p.full_name, f.detail_id, f.event_date
    FROM party_old p
    LEFT JOIN (SELECT * FROM (
                   SELECT d.*, row_number() OVER (PARTITION BY old_id
                          ORDER BY event_date NULLS LAST, detail_id) AS rn
                   FROM detail_old d) x WHERE rn = 1) f
      ON f.old_id = p.old_id
    """,
)
def _(t):
    details = t.detail_old.select("old_id", "detail_id", "event_date")
    first = first_per_key(
        details, ["old_id"], [F.col("event_date").asc_nulls_last(), F.col("detail_id").asc()]
    )
    return t.party_old.select("old_id", "full_name").join(first, "old_id", "left")


@query(
    "header_with_count",
    """
    SELECT d.detail_id, d.old_id, d.event_date, d.action, d.note, d.amount_due,
           count(l.l_orderkey) AS n_details
    FROM detail_old d LEFT JOIN lineitem l ON l.l_orderkey = d.detail_id
    GROUP BY 1, 2, 3, 4, 5, 6
    """,
)
def _(t):
    headers = t.detail_old.select(
        "detail_id", "old_id", "event_date", "action", "note", "amount_due"
    )
    return header_with_count(headers, t.lineitem, key="detail_id", detail_key="l_orderkey")


@query(
    "scratch_id_map",
    """
    WITH fresh AS (SELECT row_number() OVER (ORDER BY detail_id) AS id, event_date, action
                   FROM detail_old)
    SELECT d.detail_id AS old_id, min(f.id) AS new_id
    FROM detail_old d
    JOIN fresh f ON f.event_date = d.event_date AND f.action = d.action
    GROUP BY 1
    """,
)
def _(t):
    from remap.operators.numbering import assign_ids

    old = t.detail_old.select("detail_id", "event_date", "action")
    fresh = assign_ids(old, [F.col("detail_id").asc()], output="id")
    return scratch_id_map(
        old, fresh, old_id="detail_id", new_id="id", business=["event_date", "action"]
    )
