"""Load queries: each writes to a fresh folder and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.operators.crosswalk import attach_owner, crosswalk
from remap.operators.lookup import CodeDim, Role, resolve_codes
from remap.parity.registry import RUN_AT, query
from remap.plans.mapping import AuditBlock, map_columns
from remap.plans.steps import master_detail, region_map
from remap.session import new_path
from remap.sinks import loads
from remap.sources.copy import copy_projected


def flagship(t):
    """Details with owner, three looked-up codes and audit columns."""
    owned = attach_owner(t.detail_old, crosswalk(t.party_old, t.party_new))
    codes = CodeDim(t.code_dim, normalise=True)
    found = resolve_codes(
        owned,
        [
            Role("code_a", codes, {"code_a_id": "id"}),
            Role("code_b", codes, {"code_b_id": "id"}),
            Role(F.col("detail_id") % 25, codes, {"code_c_id": "id"}),
        ],
    )
    return map_columns(
        found,
        [
            ("detail_no", "detail_id"),
            ("owner_id", "owner_id"),
            ("code_a_id", "code_a_id"),
            ("code_b_id", "code_b_id"),
            ("code_c_id", "code_c_id"),
            ("event_time", "event_date"),
            *AuditBlock(RUN_AT).short(),
        ],
    )


_FLAGSHIP = f"""
    SELECT d.detail_id AS detail_no, n.id AS owner_id, a.id AS code_a_id, b.id AS code_b_id,
           c.id AS code_c_id, d.event_date AS event_time, TIMESTAMP '{RUN_AT}' AS creation_time,
           CAST(0 AS int) AS is_deleted
    FROM detail_old d
    JOIN party_old o ON d.old_id = o.old_id
    JOIN party_new n ON o.file_no = n.file_no
    LEFT JOIN code_dim a ON a.code = trim(d.code_a)
    LEFT JOIN code_dim b ON b.code = trim(d.code_b)
    LEFT JOIN code_dim c ON c.code = CAST(d.detail_id % 25 AS string)"""


@query(
    "reload_full",
    f"SELECT row_number() OVER (ORDER BY detail_no) AS id, * FROM ({_FLAGSHIP}) x",
)
def _(t):
    path = new_path(t.spark, "reload")
    result = loads.reload_full(
        t.spark,
        lambda: flagship(t),
        path,
        job="details",
        table="detail",
        id_order=[F.col("detail_no").asc()],
        id_key=["detail_no"],
    )
    if result.status != "success":
        raise RuntimeError(result.message)
    return t.spark.read.parquet(path)


@query(
    "reload_published",
    f"SELECT row_number() OVER (ORDER BY detail_no) AS id, * FROM ({_FLAGSHIP}) x",
)
def _(t):
    """The full reload, published by pointer: a new version folder and one catalog statement."""
    import uuid

    from remap.sinks.publish import publish

    name = f"published_detail_{uuid.uuid4().hex[:12]}"
    result = publish(
        t.spark, lambda: flagship(t), name, new_path(t.spark, "published"),
        job="details", table="detail", id_order=[F.col("detail_no").asc()], id_key=["detail_no"],
    )
    if result.status != "success":
        raise RuntimeError(result.message)
    return t.spark.table(name)


@query(
    "reload_truncate",
    f"SELECT * FROM ({_FLAGSHIP}) x",
)
def _(t):
    path = new_path(t.spark, "truncate")
    t.detail_old.write.parquet(path)  # the earlier content, to be replaced
    result = loads.reload_truncate(t.spark, flagship(t), path, job="details", table="detail")
    if result.status != "success":
        raise RuntimeError(result.message)
    return t.spark.read.parquet(path)


@query(
    "reload_audit",
    """
    SELECT 'first' AS job_name, 'detail' AS target_table, 'success' AS status,
           CAST(0 AS bigint) AS delete_rows, count(*) AS insert_rows, false AS has_message,
           count(*) AS rows_after FROM detail_old
    UNION ALL
    SELECT 'second', 'detail', 'success', (SELECT count(*) FROM detail_old), count(*), false, count(*)
    FROM detail_old WHERE action = 'OPEN'
    UNION ALL
    SELECT 'third', 'detail', 'error', NULL, NULL, true, count(*)
    FROM detail_old WHERE action = 'OPEN'
    """,
)
def _(t):
    path = new_path(t.spark, "audit")
    rows = t.detail_old
    broken = rows.withColumn("detail_id", F.assert_true(F.col("detail_id") < 0))
    results, after = [], []
    for job, frame in [("first", rows), ("second", rows.where("action = 'OPEN'")), ("third", broken)]:
        results.append(loads.reload_full(t.spark, frame, path, job=job, table="detail"))
        after.append((job, t.spark.read.parquet(path).count()))
    audit = loads.audit_frame(t.spark, results)
    left = t.spark.createDataFrame(after, "job_name string, rows_after bigint")
    return audit.join(F.broadcast(left), "job_name").select(
        "job_name",
        "target_table",
        "status",
        "delete_rows",
        "insert_rows",
        (F.col("message") != "").alias("has_message"),
        "rows_after",
    )


@query(
    "append_load",
    """
    SELECT detail_id, old_id, code_a FROM detail_old
    UNION ALL SELECT detail_id, old_id, code_a FROM detail_old
    """,
)
def _(t):
    path = new_path(t.spark, "append")
    rows = t.detail_old.select("detail_id", "old_id", "code_a")
    for _ in range(2):
        loads.append_load(rows, path, job="details", table="detail")
    return t.spark.read.parquet(path)


@query(
    "copy_projected",
    """
    SELECT o_orderkey AS ref_no, o_totalprice AS amount, o_orderpriority AS label
    FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'
    """,
)
def _(t):
    path = new_path(t.spark, "copy")
    copy_projected(
        t.orders,
        ["o_orderkey", "o_totalprice", "o_orderpriority"],
        ["ref_no", "amount", "label"],
        path=path,
        where="o_totalprice > 1000 AND o_orderstatus <> 'P'",
    )
    return t.spark.read.parquet(path)


@query(
    "multi_statement_load",
    """
    WITH first AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS bigint) AS state FROM supplier),
    added AS (SELECT * FROM first
              UNION ALL SELECT c_custkey + 1000000, c_name, CAST(c_nationkey AS bigint) FROM customer),
    updated AS (SELECT id, name, CASE WHEN state = 3 THEN -3 ELSE state END AS state FROM added),
    fewer AS (SELECT * FROM updated WHERE state <> 5),
    merged AS (SELECT f.id, coalesce(p.p_name, f.name) AS name, f.state
               FROM fewer f LEFT JOIN part p ON p.p_partkey = f.id)
    SELECT id, name, state, 'success' AS status,
           (SELECT count(*) FROM customer)
           + (SELECT count(*) FROM added WHERE state = 3)
           + (SELECT count(*) FROM updated WHERE state = 5)
           + (SELECT count(*) FROM fewer WHERE id IN (SELECT p_partkey FROM part)) AS touched
    FROM merged
    """,
)
def _(t):
    path = new_path(t.spark, "statements")
    t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("bigint").alias("state")
    ).write.parquet(path)
    more = t.customer.select(
        (F.col("c_custkey") + 1000000).alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("bigint").alias("state"),
    )
    steps = [
        loads.append_step(more),
        loads.update_step(F.col("state") == 3, {"state": F.lit(-3).cast("bigint")}),
        loads.delete_step(F.col("state") == 5),
        loads.merge_step(t.part.select("p_partkey", "p_name"), key="id", source_key="p_partkey", assign={"name": "p_name"}),
    ]
    done = loads.multi_statement_load(t.spark, path, steps, job="statements", table="target")
    failing = [loads.delete_step(F.col("state") == -3), loads.update_step(F.assert_true(F.lit(False)).isNull(), {})]
    loads.multi_statement_load(t.spark, path, failing, job="statements", table="target")
    return t.spark.read.parquet(path).select(
        "id", "name", "state", F.lit(done.status).alias("status"), F.lit(done.insert_rows).cast("bigint").alias("touched")
    )


@query(
    "multi_target_load",
    """
    SELECT 'open' AS target_table, count(*) AS insert_rows FROM detail_old WHERE action = 'OPEN'
    UNION ALL SELECT 'owner', count(*) FROM party_old
    UNION ALL SELECT 'all', (SELECT count(*) FROM detail_old WHERE action = 'OPEN')
                            + (SELECT count(*) FROM party_old)
    """,
)
def _(t):
    path = new_path(t.spark, "multi")
    results = loads.multi_target_load(
        [
            ("open", f"{path}/open", t.detail_old.where("action = 'OPEN'")),
            ("blank", f"{path}/blank", None),
            ("owner", f"{path}/owner", t.party_old),
        ],
        job="two tables",
    )
    audit = loads.audit_frame(t.spark, results).select("target_table", "insert_rows")
    total = audit.agg(F.sum("insert_rows").alias("insert_rows"))
    return audit.unionByName(total.select(F.lit("all").alias("target_table"), "insert_rows"))


@query(
    "purge_ordered",
    """
    SELECT CAST(1 AS int) AS seq, 'line' AS target_table, count(*) AS rows_deleted FROM lineitem
    UNION ALL SELECT 2, 'order', count(*) FROM orders
    UNION ALL SELECT 3, 'line', 0
    UNION ALL SELECT 4, 'owner', count(*) FROM customer
    """,
)
def _(t):
    path = new_path(t.spark, "purge")
    t.lineitem.write.parquet(f"{path}/line")
    t.orders.write.parquet(f"{path}/order")
    t.customer.write.parquet(f"{path}/owner")
    names = ["line", "order", "line", "owner"]
    return loads.purge_ordered(t.spark, [(n, f"{path}/{n}") for n in names])


# The foreign keys of the given tables, as (child, parent).
TABLE_DEPENDENCIES = [
    ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer"),
    ("customer", "nation"), ("supplier", "nation"), ("nation", "region"),
]
_DEPENDENCY_ROWS = ", ".join(f"('{c}', '{p}')" for c, p in TABLE_DEPENDENCIES)
_PURGED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query(
    "purge_by_dependency",
    f"""
    WITH RECURSIVE deps(child, parent) AS (VALUES {_DEPENDENCY_ROWS}),
    up(t, level) AS (
        SELECT child, 0 FROM deps WHERE child NOT IN (SELECT parent FROM deps)
        UNION ALL SELECT d.parent, u.level + 1 FROM up u JOIN deps d ON d.child = u.t),
    lv AS (SELECT t, max(level) AS level FROM up GROUP BY t),
    sizes AS ({" UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS n FROM {n}" for n in _PURGED)})
    SELECT CAST(level AS int) AS level, t AS target_table, n AS rows_deleted FROM lv JOIN sizes USING (t)
    """,
)
def _(t):
    """The given tables purged in the order their foreign keys ask, one step per level."""
    from remap.plans.dependencies import purge_by_dependency

    path = new_path(t.spark, "purge-deps")
    for name in _PURGED:
        getattr(t, name).write.parquet(f"{path}/{name}")
    deps = t.spark.createDataFrame(TABLE_DEPENDENCIES, "child string, parent string")
    return purge_by_dependency(t.spark, deps, {n: f"{path}/{n}" for n in _PURGED})


@query("clone_schema", "SELECT detail_id, old_id, code_a, event_date, amount_due FROM detail_old")
def _(t):
    path = new_path(t.spark, "clone")
    rows = t.detail_old.select("detail_id", "old_id", "code_a", "event_date", "amount_due")
    empty = loads.clone_schema(t.spark, rows, path)
    if empty.count():
        raise RuntimeError("a clone starts empty")
    loads.append_load(rows, path, job="fill", table="clone")
    return t.spark.read.schema(empty.schema).parquet(path)


_FOLD = (
    "regexp_replace(translate(lower(trim({c})), 'ưếị', 'uei'), '\\p{{M}}+', '', 'g')"
)


@query(
    "region_map_build",
    f"""
    SELECT o.code AS old_code, o.name AS old_name, n.code AS new_code, n.name AS new_name
    FROM region_names_old o
    LEFT JOIN region_names_new n ON {_FOLD.format(c='o.name')} = {_FOLD.format(c='n.name')}
    WHERE o.status = 1
    """,
)
def _(t):
    path = new_path(t.spark, "region_map")
    built = region_map(t.region_names_old.where("status = 1"), t.region_names_new)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    return loads.rebuild_table(t.spark, name, built, path, "Old region to new region by name")


_BUSINESS = ["action", "note", "code_a", "event_date"]


@query(
    "master_detail_load",
    """
    WITH parents AS (
        SELECT row_number() OVER (ORDER BY action NULLS LAST, note NULLS LAST, code_a NULLS LAST,
                                           event_date NULLS LAST) AS parent_id, *
        FROM (SELECT DISTINCT action, note, code_a, event_date FROM detail_old) x)
    SELECT p.parent_id, d.detail_id, n.id AS owner_id
    FROM detail_old d
    JOIN parents p ON d.action IS NOT DISTINCT FROM p.action AND d.note = p.note
                  AND d.code_a IS NOT DISTINCT FROM p.code_a AND d.event_date = p.event_date
    JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    """,
)
def _(t):
    path = new_path(t.spark, "master_detail")
    rows = t.detail_old.select("detail_id", "old_id", *_BUSINESS)
    parents, children = master_detail(rows, business=_BUSINESS, strict=["note", "event_date"])
    owned = attach_owner(children, crosswalk(t.party_old, t.party_new))
    loads.multi_target_load(
        [
            ("parent", f"{path}/parent", parents),
            ("child", f"{path}/child", owned.select("parent_id", "detail_id", "owner_id")),
        ],
        job="master detail",
    )
    return t.spark.read.parquet(f"{path}/child")
