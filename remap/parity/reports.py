"""Run log, ledger and activity log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.operators import reports as r
from remap.operators.numbering import (
    assign_ids,
    dedup_first_wins,
    paginate,
    priority_order,
    rank_by_latest,
)
from remap.parity.registry import query

_RUN = "id, job_id, job_name, target_table, run_at, status, delete_rows, insert_rows"
_RUN_LIST = _RUN.split(", ")


# Fixed value: the longest tail the activity report shows.
TAIL_MOST = 5000


@query(
    "latest_errors",
    f"""
    SELECT {_RUN} FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY run_at DESC, id DESC) AS rn
        FROM run_history) x
    WHERE rn = 1 AND status = 'error'
    """,
)
def _(t):
    return r.latest_errors(t.run_history).select(*_RUN_LIST)


@query(
    "latest_successes",
    f"""
    SELECT {_RUN} FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY run_at DESC, id DESC) AS rn
        FROM run_history WHERE status = 'success') x
    WHERE rn = 1
    """,
)
def _(t):
    return r.latest_successes(t.run_history).select(*_RUN_LIST)


@query(
    "history_by_job",
    """
    SELECT id, job_id, run_at, status,
           row_number() OVER (PARTITION BY job_id ORDER BY run_at DESC, id) AS position
    FROM run_history
    """,
)
def _(t):
    rows = t.run_history.select("id", "job_id", "run_at", "status")
    return r.history_by_job(rows)


@query(
    "delete_ledger",
    """
    SELECT id, job_name, target_table, 'DELETE FROM ' || target_table AS sql_delete,
           delete_rows AS rows_deleted, run_at,
           row_number() OVER (ORDER BY run_at DESC, id) AS position
    FROM run_history WHERE delete_rows IS NOT NULL
    """,
)
def _(t):
    ledger = t.run_history.where("delete_rows IS NOT NULL").select(
        "id",
        "job_name",
        "target_table",
        F.concat(F.lit("DELETE FROM "), "target_table").alias("sql_delete"),
        F.col("delete_rows").alias("rows_deleted"),
        "run_at",
    )
    return r.newest_first(ledger)


@query(
    "history_search",
    """
    SELECT id, job_name, target_table, 'own' AS search_kind FROM run_history
    WHERE contains(lower(job_name), 'b_7') OR contains(lower(target_table), 'b_7')
    UNION ALL
    SELECT id, job_name, target_table, 'joined' FROM run_history
    WHERE contains(lower(job_name || ' ' || target_table || ' ' || message), '1 t_1')
    """,
)
def _(t):
    runs = t.run_history
    own = r.search(runs, " B_7 ", ["job_name", "target_table"])
    joined = r.search(runs, "1 T_1", ["job_name", "target_table", "message"], joined=True)
    keep = ["id", "job_name", "target_table"]
    return own.select(*keep, F.lit("own").alias("search_kind")).unionByName(
        joined.select(*keep, F.lit("joined").alias("search_kind"))
    )


@query(
    "activity_retention",
    """
    SELECT seq, run_at, usr, action, status FROM activity_log
    WHERE try_strptime(trim(run_at), '%Y-%m-%d %H:%M:%S') IS NULL
       OR try_strptime(trim(run_at), '%Y-%m-%d %H:%M:%S')
          >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR
    """,
)
def _(t):
    kept = r.keep_recent(t.activity_log, "2024-01-20 12:00:00")
    return kept.select("seq", "run_at", "usr", "action", "status")


@query(
    "activity_tail_user",
    """
    SELECT seq, run_at, usr, action, status
    FROM (SELECT * FROM activity_log ORDER BY seq DESC LIMIT 5000) x
    WHERE usr = 'u7'
    """,
)
def _(t):
    return r.tail(t.activity_log, TAIL_MOST, user="u7", most=TAIL_MOST).select(
        "seq", "run_at", "usr", "action", "status"
    )


@query(
    "run_status_summary",
    """
    SELECT target_table, count(*) AS total,
           count(*) FILTER (WHERE status = 'success') AS success_count,
           count(*) FILTER (WHERE status = 'error') AS error_count
    FROM run_history GROUP BY 1
    """,
)
def _(t):
    return r.status_summary(t.run_history, by=["target_table"])


@query(
    "resume_remaining",
    """
    SELECT c_custkey AS id FROM customer
    WHERE c_custkey NOT IN (SELECT job_id FROM run_history WHERE status IN ('success', 'error'))
    """,
)
def _(t):
    requested = t.customer.select(F.col("c_custkey").alias("id"))
    finished = t.run_history.select(F.col("job_id").alias("id"), "status")
    return r.remaining(requested, finished)


@query(
    "paginate",
    """
    SELECT *, CAST(ceil(position / 20.0) AS bigint) AS page
    FROM (SELECT id, job_name, row_number() OVER (ORDER BY job_name, id) AS position
          FROM run_history WHERE contains(lower(job_name), 'job_1')) x
    """,
)
def _(t):
    found = r.search(t.run_history, "job_1", ["job_name"]).select("id", "job_name")
    return paginate(found, [F.col("job_name").asc_nulls_last(), F.col("id").asc()], key=["id"])


@query(
    "priority_order",
    """
    SELECT name, row_number() OVER (
        ORDER BY CASE name WHEN 'Supplier#000000007' THEN 0 WHEN 'Supplier#000000002' THEN 1
                 ELSE 2 END, name) AS position
    FROM (SELECT s_name AS name FROM supplier WHERE NOT starts_with(s_name, 'Supplier#00000001')) x
    """,
)
def _(t):
    return priority_order(
        t.supplier.select(F.col("s_name").alias("name")),
        "name",
        ["Supplier#000000007", "Supplier#000000002"],
        exclude_prefix="Supplier#00000001",
    )


@query(
    "rank_by_latest_date",
    """
    SELECT detail_id, row_number() OVER (ORDER BY
        greatest(coalesce(review_date, TIMESTAMP '1900-01-01'),
                 coalesce(paid_date, TIMESTAMP '1900-01-01')) DESC, detail_id DESC) AS rn
    FROM (SELECT detail_id, review_date, CASE WHEN amount_paid > 50000 THEN event_date END AS paid_date
          FROM detail_old) x
    """,
)
def _(t):
    rows = t.detail_old.select(
        "detail_id", "review_date", F.when(F.col("amount_paid") > 50000, F.col("event_date")).alias("paid_date")
    )
    ranked = rank_by_latest(rows, ["review_date", "paid_date"], [F.col("detail_id").desc()])
    return ranked.select("detail_id", "rn")


@query(
    "assign_ids",
    """
    SELECT row_number() OVER (ORDER BY event_date DESC NULLS LAST, detail_id) AS id,
           detail_id, event_date
    FROM detail_old
    """,
)
def _(t):
    rows = t.detail_old.select("detail_id", "event_date")
    return assign_ids(rows, [F.col("event_date").desc_nulls_last(), F.col("detail_id").asc()])


@query(
    "dedup_first_wins",
    """
    SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_partkey, p_brand, p_type
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn
          FROM part) x
    WHERE rn = 1
    """,
)
def _(t):
    rows = t.part.select("p_partkey", "p_brand", "p_type")
    return dedup_first_wins(rows, ["p_brand", "p_type"], [F.col("p_partkey").asc()])
