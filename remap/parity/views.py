"""Input views: the shapes of the old and new schema laid over the base tables.

One text serves both engines.  ``{table}`` stands for a base table: Spark binds
the table's DataFrame to it, the SQL twin gets its plain name.
"""

from __future__ import annotations

import re

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {
    # Old owners: missing file numbers, blank / NULL / lettered document numbers.
    "party_old": """
        SELECT c_custkey AS old_id,
               CASE WHEN c_custkey % 11 = 0 THEN NULL
                    ELSE 'F' || lpad(CAST(c_custkey AS string), 7, '0') END AS file_no,
               c_name AS full_name,
               CASE c_custkey % 4 WHEN 0 THEN CAST(100000 + c_custkey AS string)
                                  WHEN 1 THEN 'P' || CAST(c_custkey AS string)
                                  WHEN 2 THEN '  ' ELSE NULL END AS doc_no,
               CASE WHEN c_custkey % 3 = 0 THEN 'Đ' || CAST(c_custkey AS string)
                    ELSE NULL END AS alt_doc_no,
               CASE WHEN c_custkey % 5 = 0 THEN NULL
                    ELSE 'Street ' || CAST(c_custkey % 40 AS string) END AS street,
               CASE c_custkey % 3 WHEN 0 THEN 'XÃ ' WHEN 1 THEN 'Phường ' ELSE '' END
                    || 'Ward ' || CAST(c_nationkey AS string) AS ward_name,
               ' ' || CAST(c_nationkey AS string) || ' ' AS region_code_old,
               c_mktsegment AS segment
        FROM {customer}""",
    # New owners: other ids, some owners not carried over.
    "party_new": """
        SELECT 1000000 + c_custkey AS id,
               'F' || lpad(CAST(c_custkey AS string), 7, '0') AS file_no
        FROM {customer}
        WHERE c_acctbal >= 0""",
    # Lookup with soft-delete flag 0 / 1 / NULL.
    "code_dim": """
        SELECT CAST(500 + n_nationkey AS bigint) AS id, CAST(n_nationkey AS string) AS code,
               n_name AS title,
               CASE WHEN n_nationkey % 6 = 5 THEN 1 WHEN n_nationkey % 7 = 6 THEN NULL
                    ELSE 0 END AS is_deleted
        FROM {nation}""",
    "supplier_dim": """
        SELECT 20000 + s_suppkey AS id, CAST(s_suppkey AS string) AS code, s_name AS title
        FROM {supplier}""",
    "part_dim": """
        SELECT 40000 + p_partkey AS id, CAST(p_partkey AS string) AS code, p_name AS title,
               CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS is_deleted
        FROM {part}""",
    "segment_dim": """
        SELECT DISTINCT CAST(60 + length(c_mktsegment) AS bigint) AS id, c_mktsegment AS code
        FROM {customer}""",
    "region_map": """
        SELECT n_nationkey AS old_code,
               CASE WHEN n_nationkey % 9 = 8 THEN NULL
                    ELSE 'R' || CAST(n_regionkey AS string) END AS new_code
        FROM {nation}""",
    "region_new": """
        SELECT CAST(900 + r_regionkey AS bigint) AS id, ' R' || CAST(r_regionkey AS string) AS code,
               r_name AS title,
               CASE WHEN r_regionkey = 4 THEN NULL ELSE 0 END AS is_deleted
        FROM {region}""",
    "ward_new": """
        SELECT CAST(700 + n_nationkey AS bigint) AS id,
               'R' || CAST(n_regionkey AS string) AS region_code,
               CASE WHEN n_nationkey % 2 = 0 THEN 'Xã ' ELSE 'phường ' END
                   || 'Ward ' || CAST(n_nationkey AS string) AS name
        FROM {nation}""",
    # Details: odd codes, code lists, durations, dates in two layouts.
    "detail_old": """
        SELECT o_orderkey AS detail_id, o_custkey AS old_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    ELSE CAST(o_orderkey % 30 AS string) END AS code_a,
               ' ' || CAST((o_orderkey * 7) % 30 AS string) AS code_b,
               CASE o_orderkey % 6
                   WHEN 0 THEN NULL WHEN 1 THEN ''
                   WHEN 2 THEN CAST(o_orderkey % 25 AS string)
                   WHEN 3 THEN CAST(o_orderkey % 25 AS string) || ';;'
                               || CAST((o_orderkey + 3) % 25 AS string)
                   WHEN 4 THEN CAST((o_orderkey + 9) % 25 AS string) || '; '
                               || CAST(o_orderkey % 25 AS string) || ',99'
                   ELSE CAST(o_orderkey % 25 AS string) || ';'
                        || CAST(o_orderkey % 25 AS string) END AS code_list,
               CASE o_orderkey % 5
                   WHEN 0 THEN NULL
                   WHEN 1 THEN CAST(o_orderkey % 9 AS string) || ' năm '
                               || CAST(o_orderkey % 31 AS string) || ' ngày'
                   WHEN 2 THEN CAST(o_orderkey % 12 AS string) || ' THÁNG'
                   WHEN 3 THEN 'không rõ'
                   ELSE CAST(o_orderkey % 4 AS string) || 'năm '
                        || CAST(o_orderkey % 12 AS string) || ' tháng' END AS duration_title,
               CASE o_orderkey % 5
                   WHEN 0 THEN '31/02/2020'
                   WHEN 1 THEN lpad(CAST(1 + o_orderkey % 28 AS string), 2, '0') || '/0'
                               || CAST(1 + o_orderkey % 9 AS string) || '/1998'
                   WHEN 2 THEN '1998-0' || CAST(1 + o_orderkey % 9 AS string) || '-05'
                   WHEN 3 THEN 'abc' ELSE NULL END AS date_text,
               o_orderdate AS event_date,
               CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderdate END AS review_date,
               o_totalprice AS amount_due,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL
                    ELSE CAST(floor(o_totalprice / 4) AS double) END AS amount_paid,
               CASE WHEN o_orderkey % 7 = 0 THEN 'close' WHEN o_orderkey % 7 = 1 THEN NULL
                    ELSE 'OPEN' END AS action,
               o_orderpriority AS note
        FROM {orders}""",
    # "left, right" names for the split, merge and update operators.
    "team_dim": """
        SELECT p_partkey AS id, 'T' || CAST(p_partkey AS string) AS code,
               CASE WHEN p_partkey % 10 = 0 THEN 'Unassigned'
                    WHEN p_partkey % 10 = 1 THEN p_name
                    ELSE p_name || ', ' || p_brand END AS name,
               p_size AS status
        FROM {part}""",
    "team_existing": """
        SELECT DISTINCT CAST(substring(p_brand, 7) AS bigint) AS id, p_brand AS name
        FROM {part}
        WHERE p_brand LIKE 'Brand#1%'""",
    # Region names with and without accents.
    "region_names_old": """
        SELECT s_suppkey AS code, replace(replace(upper(s_name), 'U', 'Ư'), 'E', 'Ế') AS name,
               CASE WHEN s_acctbal > 500 THEN 1 ELSE 0 END AS status
        FROM {supplier}""",
    "region_names_new": """
        SELECT 'N' || CAST(s_suppkey AS string) AS code,
               ' ' || replace(s_name, 'i', 'ị') AS name
        FROM {supplier}
        WHERE s_acctbal < 9000""",
    "band_dim": """
        SELECT 300 + s_suppkey AS id,
               CASE WHEN s_suppkey < 60
                    THEN CAST(s_suppkey % 9 AS string) || ' Năm ' || CAST(s_suppkey % 31 AS string)
                         || ' NGÀY'
                    ELSE CAST(s_suppkey % 4 AS string) || ' năm ' || CAST(s_suppkey % 12 AS string)
                         || ' tháng' END AS title
        FROM {supplier}""",
    # Run log: many runs in one hour, NULL counts on error.
    "run_history": """
        SELECT event_id AS id, user_id AS job_id, 'JOB_' || CAST(user_id AS string) AS job_name,
               'T_' || CAST(user_id % 20 AS string) AS target_table,
               date_trunc('hour', ts) AS run_at,
               CASE WHEN event_type IN ('error', 'signup') THEN 'error' ELSE 'success' END AS status,
               CASE WHEN event_type IN ('error', 'signup') THEN NULL
                    ELSE CAST(floor(value) AS bigint) END AS delete_rows,
               CASE WHEN event_type IN ('error', 'signup') THEN NULL
                    ELSE event_id % 1000 END AS insert_rows,
               event_type AS message
        FROM {events}""",
    "activity_log": """
        SELECT event_id AS seq,
               CASE WHEN event_id % 97 = 0 THEN 'n/a'
                    ELSE substr(CAST(date_trunc('second', ts) AS string), 1, 19) END AS run_at,
               'u' || CAST(user_id AS string) AS usr, event_type AS action,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               props AS meta
        FROM {events}""",
    # Job registry: ids that are no numbers, SQL text over two lines with quotes.
    "registry_rows": """
        SELECT CASE WHEN p_partkey % 17 = 0 THEN 'x' || CAST(p_partkey AS string)
                    ELSE CAST(p_partkey AS string) END AS id,
               'JOB_' || upper(p_name) AS name, 'SRC' AS source_connection_name,
               'TGT' AS target_connection_name, 'OLD_' || p_type AS source_table,
               'NEW_' || p_type AS target_table,
               'INSERT INTO t ("a", "b")' || chr(10) || 'SELECT a, ''' || p_brand
                   || ''' FROM s' AS sql_text
        FROM {part}""",
    # Column catalog: one table per order, one column per part on it.
    "order_columns": """
        SELECT 'ORDER_' || CAST(l_orderkey AS string) AS table_name,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS column_id,
               'PART_' || CAST(l_partkey AS string) AS column_name
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem}) AS x""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def base_tables(name: str) -> list[str]:
    """Base tables a view reads."""
    return sorted(set(_TABLE.findall(VIEWS[name])))


def sql_text(name: str) -> str:
    """View text over the plain table names."""
    return _TABLE.sub(lambda m: m[1], VIEWS[name])


def with_views(body: str) -> str:
    """SQL body with the views it mentions put in front as named subqueries."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{v} AS ({sql_text(v)})" for v in used)
    return f"WITH {ctes}\nSELECT * FROM (\n{body}\n) AS answer"
