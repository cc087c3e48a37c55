"""Registry, run-log file, catalog and JSON queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.operators.reports import search
from remap.parity.registry import query
from remap.plans.mapping import map_columns, read_mapping
from remap.session import materialize, new_path
from remap.sources.activity import read_activity, write_activity
from remap.sources.catalog import column_catalog, read_snapshot, write_snapshot
from remap.sources.notes import explode_json, pack_json, read_notes, write_notes
from remap.sources.registry import read_registry, write_registry
from remap.sources.runlog import (
    DELETE_LEDGER,
    HISTORY,
    SCRIPT_HISTORY,
    read_records,
    write_records,
)


@query(
    "registry_read",
    """
    SELECT CAST(id AS bigint) AS id, name, source_connection_name, target_connection_name,
           source_table, target_table, sql_text
    FROM registry_rows WHERE TRY_CAST(id AS bigint) IS NOT NULL
    """,
)
def _(t):
    path = new_path(t.spark, "registry")
    write_registry(t.registry_rows, path)
    return read_registry(t.spark, path)


@query(
    "history_read",
    """
    SELECT id, job_id AS stmt_id, job_name, target_table,
           strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at, status, message,
           delete_rows, insert_rows
    FROM run_history
    """,
)
def _(t):
    path = new_path(t.spark, "history")
    rows = t.run_history.withColumnRenamed("job_id", "stmt_id").withColumn(
        "run_at", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss")
    )
    write_records(rows, path, HISTORY)
    return read_records(t.spark, path, HISTORY)


@query(
    "ledger_read",
    """
    SELECT id, job_id AS stmt_id, job_name, 'main' AS target_connection_name, target_table,
           'DELETE FROM ' || target_table AS sql_delete,
           strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at, delete_rows AS rows_deleted
    FROM run_history WHERE delete_rows > 0
    """,
)
def _(t):
    path = new_path(t.spark, "ledger")
    rows = t.run_history.where("delete_rows > 0").select(
        "id",
        F.col("job_id").alias("stmt_id"),
        "job_name",
        F.lit("main").alias("target_connection_name"),
        "target_table",
        F.concat(F.lit("DELETE FROM "), "target_table").alias("sql_delete"),
        F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"),
        F.col("delete_rows").alias("rows_deleted"),
    )
    write_records(rows, path, DELETE_LEDGER)
    return read_records(t.spark, path, DELETE_LEDGER)


def _scripts(t):
    path = new_path(t.spark, "scripts")
    rows = t.run_history.select(
        "id",
        (F.col("id") % 3).alias("connection_id"),
        F.concat("job_name", F.lit(".sql")).alias("filename"),
        F.lit("main").alias("connection_name"),
        F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"),
        "status",
        "message",
    )
    write_records(rows, path, SCRIPT_HISTORY)
    return read_records(t.spark, path, SCRIPT_HISTORY)


_SCRIPTS = """
    SELECT id, id % 3 AS connection_id, job_name || '.sql' AS filename, 'main' AS connection_name,
           strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at, status, message
    FROM run_history
"""


@query("script_history_read", _SCRIPTS)
def _(t):
    return _scripts(t)


@query(
    "search_all_logs",
    f"""
    SELECT 'history' AS log, id FROM run_history WHERE contains(lower(job_name), 'b_7')
    UNION ALL
    SELECT 'ledger', id FROM run_history
    WHERE delete_rows > 0 AND contains('delete from ' || lower(target_table), 'from t_1')
    UNION ALL
    SELECT 'script', id FROM ({_SCRIPTS}) s WHERE contains(lower(filename), 'b_7.sql')
    """,
)
def _(t):
    ledger = t.run_history.where("delete_rows > 0").select(
        "id", F.concat(F.lit("DELETE FROM "), "target_table").alias("sql_delete")
    )
    found = {
        "history": search(t.run_history, "B_7", ["job_name"]),
        "ledger": search(ledger, "from T_1", ["sql_delete"]),
        "script": search(_scripts(t), "b_7.SQL", ["filename"]),
    }
    parts = [df.select(F.lit(log).alias("log"), "id") for log, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "search_indexed",
    f"""
    SELECT 'history' AS log, id FROM run_history WHERE contains(lower(job_name), 'b_7')
    UNION ALL
    SELECT 'ledger', id FROM run_history
    WHERE delete_rows > 0 AND contains('delete from ' || lower(target_table), 'from t_1')
    UNION ALL
    SELECT 'script', id FROM ({_SCRIPTS}) s WHERE contains(lower(filename), 'b_7.sql')
    """,
)
def _(t):
    """The searches of ``search_all_logs`` through trigram postings of the three logs."""
    from remap.operators.search_index import index_texts, search_indexed

    # The records are parsed once; the index and the search read them several times.
    scripts = materialize(_scripts(t).select("id", "filename"), "scripts")
    ledger = t.run_history.where("delete_rows > 0").select(
        "id", F.concat(F.lit("DELETE FROM "), "target_table").alias("sql_delete")
    )
    logs = {
        "history": (t.run_history, "job_name", "B_7"),
        "ledger": (ledger, "sql_delete", "from T_1"),
        "script": (scripts, "filename", "b_7.SQL"),
    }
    parts = []
    for log, (rows, column, keyword) in logs.items():
        path = new_path(t.spark, f"postings-{log}")
        index_texts(rows, path, id_col="id", columns=[column])
        found = search_indexed(t.spark, path, rows, keyword, id_col="id", columns=[column])
        parts.append(found.select(F.lit(log).alias("log"), "id"))
    return reduce(DataFrame.unionByName, parts)


@query("activity_read", "SELECT seq, run_at, usr, action, status, meta FROM activity_log")
def _(t):
    path = new_path(t.spark, "activity")
    write_activity(t.activity_log, path)
    return read_activity(t.spark, path)


@query("notes_read", "SELECT r_name AS name, 'seen \"' || r_name || '\"' AS note FROM region")
def _(t):
    path = new_path(t.spark, "notes")
    note = F.concat(F.lit('seen "'), "r_name", F.lit('"')).alias("note")
    write_notes(t.region.select(F.col("r_name").alias("name"), note), path)
    return read_notes(t.spark, path)


@query(
    "mapping_read",
    "SELECT o_orderkey AS ref_no, upper(o_orderstatus) AS state, o_totalprice * 2 AS doubled FROM orders",
)
def _(t):
    path = new_path(t.spark, "mapping")
    stored = [(7, 3, "o_totalprice * 2", "doubled"), (7, 1, "o_orderkey", "ref_no"),
              (7, 2, "upper(o_orderstatus)", "state"), (8, 1, "o_custkey", "other")]
    columns = "job_id bigint, column_order int, source string, target string"
    t.spark.createDataFrame(stored, columns).write.parquet(path)
    return map_columns(t.orders, read_mapping(t.spark.read.parquet(path), job_id=7))


@query("catalog_explode", "SELECT table_name, column_id, column_name FROM order_columns")
def _(t):
    path = new_path(t.spark, "catalog")
    write_snapshot(t.order_columns, path)
    return read_snapshot(t.spark, path)


@query(
    "catalog_collapse",
    """
    SELECT table_name || ': ' || string_agg(column_name, ', ' ORDER BY column_id) AS value
    FROM order_columns GROUP BY table_name
    """,
)
def _(t):
    path = new_path(t.spark, "catalog")
    write_snapshot(t.order_columns, path)
    return t.spark.read.text(path)


@query(
    "meta_json",
    """
    SELECT seq, 'k' AS key, json_extract_string(meta, '$.k') AS value,
           '{"k":"' || json_extract_string(meta, '$.k') || '"}' AS meta_again
    FROM activity_log WHERE json_extract_string(meta, '$.k') IS NOT NULL
    """,
)
def _(t):
    pairs = explode_json(t.activity_log, "meta", keep=["seq"])
    packed = pack_json(pairs, keep=["seq"], output="meta_again")
    return pairs.join(packed, "seq")


# The columns of the tables whose name holds "er", with Spark's type names.
_COLUMNS = {
    "conversations": ["conv_id bigint", "turn bigint", "role string", "text string"],
    "customer": [
        "c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double",
        "c_mktsegment string",
    ],
    "orders": [
        "o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double",
        "o_orderdate timestamp_ntz", "o_orderpriority string",
    ],
    "supplier": ["s_suppkey bigint", "s_name string", "s_nationkey int", "s_acctbal double"],
}


def _column_sql(table: str, position: int, spec: str) -> str:
    name, kind = spec.split()
    length = f"max(octet_length(encode({name})))" if kind == "string" else "NULL"
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type, "
        f"CAST({length} AS bigint) AS data_length, "
        f"CASE WHEN count(*) > count({name}) THEN 'Y' ELSE 'N' END AS nullable, "
        f"CAST({position} AS bigint) AS column_id FROM {table}"
    )


@query(
    "catalog_columns",
    "\nUNION ALL\n".join(
        _column_sql(table, i, spec)
        for table, specs in _COLUMNS.items()
        for i, spec in enumerate(specs, start=1)
    ),
)
def _(t):
    from remap.parity.views import BASE

    return column_catalog({name: getattr(t, name) for name in BASE}, "eR", measure=True)
