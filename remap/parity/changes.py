"""Row-changing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.functions import before_delimiter
from remap.operators.changes import (
    delete_by_ids,
    insert_if_absent,
    merge_update,
    update_by_key,
    update_where,
)
from remap.parity.registry import query
from remap.plans.steps import name_part_tokens


@query(
    "insert_if_absent",
    """
    WITH tokens AS (
        SELECT trim(split_part(name, ',', 2)) AS name, min(code) AS code, max(status) AS status
        FROM team_dim WHERE name LIKE '%,%' GROUP BY 1
        UNION ALL
        SELECT 'Unassigned', min(code), max(status) FROM team_dim WHERE name = 'Unassigned')
    SELECT (SELECT coalesce(max(id), 0) FROM team_existing)
               + row_number() OVER (ORDER BY k.name) AS id,
           k.name, k.code, k.status
    FROM tokens k WHERE NOT EXISTS (SELECT 1 FROM team_existing e WHERE e.name = k.name)
    """,
)
def _(t):
    tokens = name_part_tokens(
        t.team_dim, name="name", code="code", status="status", extra="Unassigned"
    )
    return insert_if_absent(t.team_existing, tokens, match="name")


@query(
    "merge_update",
    """
    SELECT d.id, d.name, coalesce(e.id, -1) AS parent_id
    FROM team_dim d LEFT JOIN team_existing e ON e.name = trim(split_part(d.name, ',', 2))
    """,
)
def _(t):
    from remap.operators.joins import join_on_key
    from remap.plans.steps import parent_name

    teams = t.team_dim.select("id", "name", F.lit(-1).cast("bigint").alias("parent_id"))
    parents = t.team_existing.select(F.col("id").alias("new_parent"), F.col("name").alias("p_name"))
    source = join_on_key(teams.select("id", "name"), parents, parent_name("name", "Unassigned"), "p_name")
    return merge_update(
        teams, source, key="id", source_key="id", assign={"parent_id": "new_parent"}
    )


@query(
    "merge_update_loose",
    """
    SELECT d.id, d.name, CASE WHEN d.id % 2 = 0 THEN d.status + 1 ELSE d.status END AS status FROM team_dim d
    """,
)
def _(t):
    """A source that repeats NULL keys and keys without a target row is a valid one."""
    rows = t.team_dim.select("id", "name", "status")
    even = rows.where("id % 2 = 0").select(F.col("id").alias("at"), (F.col("status") + 1).alias("new"))
    lost = rows.select(F.lit(None).cast("bigint").alias("at"), F.col("status").alias("new"))
    source = even.unionByName(lost).unionByName(lost.withColumn("at", F.lit(-1).cast("bigint")))
    return merge_update(rows, source, key="id", source_key="at", assign={"status": "new"})


@query(
    "update_case",
    """
    SELECT id, CASE WHEN strpos(name, ',') > 0
                    THEN trim(substr(name, 1, strpos(name, ',') - 1)) ELSE name END AS name
    FROM team_dim
    """,
)
def _(t):
    teams = t.team_dim.select("id", "name")
    return update_where(
        teams, F.instr(F.col("name"), ",") > 0, {"name": before_delimiter("name", ",")}
    )


@query(
    "delete_by_ids",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    rows = t.documents.select("doc_id", "lang", "source")
    return delete_by_ids(rows, t.labels, key="doc_id", id_column="doc_id")


@query(
    "update_by_key",
    """
    SELECT detail_id, CASE WHEN detail_id = 100 THEN 'done' ELSE action END AS action
    FROM detail_old
    """,
)
def _(t):
    rows = t.detail_old.select("detail_id", "action")
    return update_by_key(rows, key="detail_id", value=100, assign={"action": F.lit("done")})


@query(
    "merge_partitioned",
    """
    SELECT d.id, d.name, coalesce(e.id, -1) AS parent_id
    FROM team_dim d LEFT JOIN team_existing e ON e.name = trim(split_part(d.name, ',', 2))
    """,
)
def _(t):
    """The merge of ``merge_update`` into a table kept by key: only hit partitions are rewritten."""
    from remap.operators.joins import join_on_key
    from remap.plans.steps import parent_name
    from remap.session import new_path
    from remap.sinks.keyed import merge_partitioned, read_keyed, store_by_key

    path = new_path(t.spark, "keyed-teams")
    teams = t.team_dim.select("id", "name", F.lit(-1).cast("bigint").alias("parent_id"))
    store_by_key(teams, path, key="id")
    parents = t.team_existing.select(F.col("id").alias("new_parent"), F.col("name").alias("p_name"))
    source = join_on_key(teams.select("id", "name"), parents, parent_name("name", "Unassigned"), "p_name")
    merge_partitioned(t.spark, path, source, key="id", source_key="id", assign={"parent_id": "new_parent"})
    return read_keyed(t.spark, path)


@query(
    "delete_partitioned",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    """The delete of ``delete_by_ids`` from a table kept by key: only hit partitions are rewritten."""
    from remap.session import new_path
    from remap.sinks.keyed import delete_partitioned, read_keyed, store_by_key

    path = new_path(t.spark, "keyed-docs")
    store_by_key(t.documents.select("doc_id", "lang", "source"), path, key="doc_id")
    delete_partitioned(t.spark, path, t.labels, key="doc_id", id_column="doc_id")
    return read_keyed(t.spark, path)
