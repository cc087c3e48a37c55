"""Whole loads, each declared as one spec or one multi-step plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.functions import (
    balance,
    blank_to_null,
    bracketed,
    clip,
    first_filled,
    has_letter,
    iso_date_text,
    null_safe_sum,
    oconcat,
    year_label,
)
from remap.operators.crosswalk import attach_owner, crosswalk, shared_crosswalk
from remap.operators.joins import composite_join, top_value, with_one_row, with_scalar
from remap.operators.lookup import CodeDim, Role, match_local_name
from remap.operators.numbering import first_per_key
from remap.operators.sizing import settled
from remap.parity.lists import _tokens
from remap.parity.lookups import PLACE_PREFIXES, local_name_sql, regions
from remap.parity.registry import RUN_AT, query
from remap.plans.batch import run_batch
from remap.plans.mapping import AuditBlock
from remap.plans.spec import ListLink, LoadSpec, OwnerLink, build, run
from remap.plans.steps import split_teams
from remap.session import new_path
from remap.sinks import loads
from remap.sources.runlog import HISTORY, read_records

_AUDIT = AuditBlock(RUN_AT)
_AUDIT_SQL = f"TIMESTAMP '{RUN_AT}' AS creation_time, CAST(0 AS int) AS is_deleted"


def _owners(t, how: str = "inner") -> OwnerLink:
    return OwnerLink(crosswalk(t.party_old, t.party_new, how=how), how=how)


@query(
    "load_register",
    rf"""
    SELECT row_number() OVER (ORDER BY p.old_id) AS id, p.file_no, p.full_name,
           CASE WHEN NOT regexp_matches(coalesce(p.doc_no, p.alt_doc_no), '\p{{L}}')
                THEN coalesce(p.doc_no, p.alt_doc_no) END AS number_doc,
           CASE WHEN regexp_matches(coalesce(p.doc_no, p.alt_doc_no), '\p{{L}}')
                THEN coalesce(p.doc_no, p.alt_doc_no) END AS letter_doc,
           coalesce(p.street, '') || ', ' || p.ward_name AS address, s.id AS segment_id,
           r.id AS region_id, w.id AS ward_id, {_AUDIT_SQL}
    FROM party_old p
    LEFT JOIN segment_dim s ON s.code = p.segment
    LEFT JOIN region_map m ON trim(CAST(m.old_code AS string)) = trim(p.region_code_old)
    LEFT JOIN region_new r ON trim(m.new_code) = trim(r.code) AND coalesce(r.is_deleted, 0) = 0
    LEFT JOIN (SELECT id, trim(region_code) AS region, {local_name_sql("name")} AS local_name FROM ward_new) w
      ON w.region = trim(m.new_code) AND w.local_name = {local_name_sql("p.ward_name")}
    """,
)
def _(t):
    table = regions(t)
    from remap.operators.lookup import resolve_codes

    placed = resolve_codes(
        t.party_old,
        [Role("region_code_old", table, {"region_id": "region_id", "region_new": "new_code"})],
    )
    placed = match_local_name(
        placed, t.ward_new, name="ward_name", region="region_new", prefixes=PLACE_PREFIXES,
        output="ward_id",
    )
    doc = first_filled("doc_no", "alt_doc_no")
    spec = LoadSpec(
        target="register",
        source=placed,
        roles=[Role("segment", CodeDim(t.segment_dim), {"segment_id": "id"})],
        columns=[
            ("old_id", "old_id"),
            ("file_no", "file_no"),
            ("full_name", "full_name"),
            ("number_doc", F.when(~has_letter(doc), doc)),
            ("letter_doc", F.when(has_letter(doc), doc)),
            ("address", oconcat("street", F.lit(", "), "ward_name")),
            ("segment_id", "segment_id"),
            ("region_id", "region_id"),
            ("ward_id", "ward_id"),
        ],
        audit=_AUDIT,
        id_order=[F.col("old_id").asc()],
    )
    path = new_path(t.spark, "register")
    result = run(t.spark, spec, path)
    if result.status != "success":
        raise RuntimeError(result.message)
    return t.spark.read.parquet(path).drop("old_id")


@query(
    "load_list_detail",
    rf"""
    SELECT d.detail_id, n.id AS owner_id, f.id_list, r.id AS region_id,
           CASE WHEN d.duration_title IS NOT NULL THEN coalesce(CAST(nullif(
               regexp_extract(d.duration_title, '(?i)(\d+)\s*năm', 1), '') AS bigint), 0) END AS span_year,
           CASE WHEN d.duration_title IS NOT NULL THEN coalesce(CAST(nullif(
               regexp_extract(d.duration_title, '(?i)(\d+)\s*tháng', 1), '') AS bigint), 0) END AS span_month,
           CASE WHEN d.duration_title IS NOT NULL THEN coalesce(CAST(nullif(
               regexp_extract(d.duration_title, '(?i)(\d+)\s*ngày', 1), '') AS bigint), 0) END AS span_day,
           {_AUDIT_SQL}
    FROM detail_old d
    JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    LEFT JOIN (SELECT e.detail_id,
                      string_agg(CAST(c.id AS string), ',' ORDER BY e.position) AS id_list
               FROM ({_tokens(';')}) e
               JOIN code_dim c ON trim(c.code) = e.code AND coalesce(c.is_deleted, 0) = 0
               GROUP BY 1) f ON f.detail_id = d.detail_id
    LEFT JOIN region_map m ON trim(CAST(m.old_code AS string)) = trim(d.code_b)
    LEFT JOIN region_new r ON trim(m.new_code) = trim(r.code) AND coalesce(r.is_deleted, 0) = 0
    """,
)
def _(t):
    spec = LoadSpec(
        target="list_detail",
        source=t.detail_old,
        owner=_owners(t),
        lists=[
            ListLink(
                "code_list",
                CodeDim(t.code_dim, deleted="lenient", normalise=True),
                "id_list",
                blank="stop",
            )
        ],
        regions={"code_b": "region_id"},
        region_table=regions(t),
        durations={"duration_title": "span_"},
        columns=[
            (c, c)
            for c in ("detail_id", "owner_id", "id_list", "region_id", "span_year", "span_month", "span_day")
        ],
        audit=_AUDIT,
        clear="truncate",
    )
    path = new_path(t.spark, "list_detail")
    result = run(t.spark, spec, path)
    if result.status != "success":
        raise RuntimeError(result.message)
    return t.spark.read.parquet(path)


@query(
    "load_ratings",
    f"""
    SELECT d.detail_id, n.id AS owner_id, year(d.event_date) AS year_no,
           q1.id AS q1_id, q2.id AS q2_id, q3.id AS q3_id, q4.id AS q4_id,
           h1.id AS h1_id, h2.id AS h2_id, ca.id AS all_id,
           coalesce(m.due, 0) + coalesce(m.paid, 0) AS money, {_AUDIT_SQL}
    FROM detail_old d
    JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    LEFT JOIN code_dim q1 ON q1.code = CAST(d.detail_id % 26 AS string)
    LEFT JOIN code_dim q2 ON q2.code = CAST(d.detail_id % 27 AS string)
    LEFT JOIN code_dim q3 ON q3.code = CAST(d.detail_id % 28 AS string)
    LEFT JOIN code_dim q4 ON q4.code = CAST(d.detail_id % 29 AS string)
    LEFT JOIN code_dim h1 ON h1.code = CAST(d.detail_id % 30 AS string)
    LEFT JOIN code_dim h2 ON h2.code = CAST(d.detail_id % 31 AS string)
    LEFT JOIN code_dim ca ON ca.code = CAST(d.detail_id % 32 AS string)
    LEFT JOIN (SELECT old_id, year(event_date) AS y, max(amount_due) AS due, max(amount_paid) AS paid
               FROM detail_old WHERE action = 'OPEN' GROUP BY 1, 2) m
      ON m.old_id = d.old_id AND m.y = year(d.event_date)
    """,
)
def _(t):
    rows = t.detail_old.withColumn("year_no", F.year("event_date").cast("bigint"))
    money = (
        rows.where("action = 'OPEN'")
        .groupBy(F.col("old_id").alias("m_id"), F.col("year_no").alias("m_year"))
        .agg(F.max("amount_due").alias("due"), F.max("amount_paid").alias("paid"))
    )
    paid = composite_join(
        rows.select("detail_id", "old_id", "year_no"),
        settled(money, "money"),
        [("old_id", "m_id"), ("year_no", "m_year")],
    )
    codes = CodeDim(t.code_dim)
    names = ["q1_id", "q2_id", "q3_id", "q4_id", "h1_id", "h2_id", "all_id"]
    spec = LoadSpec(
        target="ratings",
        source=paid,
        owner=_owners(t),
        roles=[
            Role(F.col("detail_id") % (26 + i), codes, {name: "id"}) for i, name in enumerate(names)
        ],
        columns=[
            ("detail_id", "detail_id"),
            ("owner_id", "owner_id"),
            ("year_no", "year_no"),
            *[(n, n) for n in names],
            ("money", null_safe_sum("due", "paid")),
        ],
        audit=_AUDIT,
        clear="truncate",
    )
    return build(spec)


@query(
    "load_reductions",
    f"""
    SELECT d.detail_id, n.id AS owner_id, coalesce(a.title, f.note) AS served,
           coalesce(b.title, f.action) AS left_over,
           nullif(coalesce(d.note, '') || CASE WHEN d.action IS NOT NULL
                  THEN chr(10) || d.action ELSE '' END, '') AS remark, {_AUDIT_SQL}
    FROM detail_old d
    JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old_id
                   ORDER BY event_date NULLS LAST, detail_id) AS rn FROM detail_old) x WHERE rn = 1) f
      ON f.old_id = d.old_id
    LEFT JOIN code_dim a ON a.code = d.code_a AND coalesce(a.is_deleted, 0) = 0
    LEFT JOIN code_dim b ON b.code = trim(d.code_b) AND coalesce(b.is_deleted, 0) = 0
    """,
)
def _(t):
    details = t.detail_old
    first = first_per_key(
        details.select("old_id", "event_date", "detail_id", "note", "action"),
        ["old_id"],
        [F.col("event_date").asc_nulls_last(), F.col("detail_id").asc()],
    ).select("old_id", F.col("note").alias("f_note"), F.col("action").alias("f_action"))
    live = CodeDim(t.code_dim, values=("title",), deleted="lenient", normalise=True)
    spec = LoadSpec(
        target="reductions",
        source=details.join(settled(first, "first"), "old_id", "left"),
        owner=_owners(t),
        roles=[
            Role("code_a", live, {"a_title": "title"}),
            Role("code_b", live, {"b_title": "title"}),
        ],
        columns=[
            ("detail_id", "detail_id"),
            ("owner_id", "owner_id"),
            ("served", first_filled("a_title", "f_note")),
            ("left_over", first_filled("b_title", "f_action")),
            (
                "remark",
                oconcat("note", F.when(F.col("action").isNotNull(), oconcat(F.lit("\n"), "action"))),
            ),
        ],
        audit=_AUDIT,
    )
    return build(spec)


@query(
    "load_periods",
    f"""
    SELECT d.detail_id, strftime(coalesce(d.review_date, d.event_date), '%Y') AS year_text,
           'Round ' || strftime(coalesce(d.review_date, d.event_date), '%Y') AS round_name,
           coalesce(nullif(d.code_a, ''), o.code) AS decision_no, o.status AS locked, {_AUDIT_SQL}
    FROM detail_old d
    LEFT JOIN (SELECT * FROM team_dim ORDER BY id LIMIT 1) o ON 1 = 1
    """,
)
def _(t):
    one = t.team_dim.select("id", "code", "status")
    day = F.coalesce("review_date", "event_date")
    spec = LoadSpec(
        target="periods",
        source=with_one_row(t.detail_old, one, order=[F.col("id").asc()], prefix="o_"),
        columns=[
            ("detail_id", "detail_id"),
            ("year_text", year_label(day)),
            ("round_name", year_label(day, "Round ")),
            ("decision_no", first_filled("code_a", "o_code")),
            ("locked", "o_status"),
        ],
        audit=_AUDIT,
    )
    return build(spec)


@query(
    "load_relatives",
    rf"""
    SELECT d.detail_id, n.id AS owner_id, a.id AS relation_id, b.id AS kind_id,
           CASE WHEN regexp_full_match(d.date_text, '\d{{2}}/\d{{2}}/\d{{4}}')
                THEN strftime(try_strptime(d.date_text, '%d/%m/%Y'), '%Y-%m-%d')
                WHEN regexp_full_match(d.date_text, '\d{{4}}-\d{{2}}-\d{{2}}') THEN d.date_text
           END AS birth_text,
           substr(d.note, 1, 10) AS phone, TIMESTAMP '{RUN_AT}' AS creation_time,
           CAST(NULL AS bigint) AS creator_user_id, CAST(NULL AS timestamp) AS last_modification_time,
           CAST(NULL AS bigint) AS last_modifier_user_id, CAST(0 AS int) AS is_deleted,
           CAST(NULL AS bigint) AS deleter_user_id, CAST(NULL AS timestamp) AS deletion_time
    FROM detail_old d
    JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    JOIN code_dim a ON a.code = d.code_a
    JOIN code_dim b ON b.code = trim(d.code_b)
    """,
)
def _(t):
    codes = CodeDim(t.code_dim, normalise=True)
    spec = LoadSpec(
        target="relatives",
        source=t.detail_old,
        owner=_owners(t),
        roles=[
            Role("code_a", codes, {"relation_id": "id"}, required=True),
            Role("code_b", codes, {"kind_id": "id"}, required=True),
        ],
        columns=[
            ("detail_id", "detail_id"),
            ("owner_id", "owner_id"),
            ("relation_id", "relation_id"),
            ("kind_id", "kind_id"),
            ("birth_text", iso_date_text("date_text")),
            ("phone", clip("note", 10)),
        ],
        audit=_AUDIT,
        full_audit=True,
    )
    return build(spec)


@query(
    "load_priors",
    f"""
    WITH token AS (
        SELECT detail_id, unnest(string_split(code_list, ';')) AS code FROM detail_old),
    known AS (
        SELECT detail_id, list_sort(list(DISTINCT id)) AS ids FROM token JOIN code_dim USING (code) GROUP BY detail_id)
    SELECT d.detail_id, n.id AS owner_id, '[' || array_to_string(known.ids, ',') || ']' AS id_list,
           coalesce(a.id, 0) AS note_id, '[' || coalesce(CAST(a.id AS string), '') || ']' AS note_list, {_AUDIT_SQL}
    FROM detail_old d
    JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    LEFT JOIN known ON known.detail_id = d.detail_id
    LEFT JOIN code_dim a ON a.code = d.code_a
    """,
)
def _(t):
    from remap.operators.codelists import codes_to_ids

    codes = CodeDim(t.code_dim)
    rows = codes_to_ids(
        t.detail_old, "code_list", codes, output="id_list", by_id=True, trim=False, blank="keep"
    )
    spec = LoadSpec(
        target="priors",
        source=rows,
        owner=_owners(t),
        roles=[Role("code_a", codes, {"a_id": "id"})],
        columns=[
            ("detail_id", "detail_id"),
            ("owner_id", "owner_id"),
            ("id_list", "id_list"),
            ("note_id", "coalesce(a_id, 0)"),
            ("note_list", bracketed("a_id")),
        ],
        audit=_AUDIT,
    )
    return build(spec)


@query(
    "load_rows_per_code",
    f"""
    SELECT d.detail_id, n.id AS owner_id, c.id AS code_id, {_AUDIT_SQL}
    FROM detail_old d
    JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    LEFT JOIN (SELECT detail_id, unnest(list_filter(string_split(code_list, ';'),
                                                    lambda s: s <> '')) AS code
               FROM detail_old) x ON x.detail_id = d.detail_id
    LEFT JOIN code_dim c ON c.code = x.code
    """,
)
def _(t):
    spec = LoadSpec(
        target="rows_per_code",
        source=t.detail_old.select("detail_id", "old_id", "code_list"),
        rows_per_code=("code_list", "one_code"),
        owner=_owners(t),
        roles=[Role("one_code", CodeDim(t.code_dim), {"code_id": "id"})],
        columns=[("detail_id", "detail_id"), ("owner_id", "owner_id"), ("code_id", "code_id")],
        audit=_AUDIT,
    )
    return build(spec)


@query(
    "load_penalties",
    f"""
    SELECT d.detail_id, x.new_id AS owner_id, TRY_CAST(trim(d.code_b) AS bigint) AS kind_no,
           d.amount_due, d.amount_due - coalesce(d.amount_paid, 0) AS amount_left, {_AUDIT_SQL}
    FROM detail_old d
    LEFT JOIN (SELECT o.old_id, n.id AS new_id
               FROM party_old o LEFT JOIN party_new n ON n.file_no = o.file_no) x
      ON d.old_id = x.old_id
    """,
)
def _(t):
    spec = LoadSpec(
        target="penalties",
        source=t.detail_old,
        owner=_owners(t, "left"),
        columns=[
            ("detail_id", "detail_id"),
            ("owner_id", "owner_id"),
            ("kind_no", "try_cast(trim(code_b) AS bigint)"),
            ("amount_due", "amount_due"),
            ("amount_left", balance("amount_due", "amount_paid")),
        ],
        audit=_AUDIT,
    )
    return build(spec)


@query(
    "load_period_members",
    """
    SELECT d.detail_id, n.id AS owner_id,
           (SELECT id FROM (SELECT row_number() OVER (ORDER BY detail_id) AS id, event_date, detail_id
                            FROM detail_old) q
            ORDER BY event_date DESC, detail_id DESC LIMIT 1) AS period_id
    FROM detail_old d
    LEFT JOIN party_old o ON o.old_id = d.old_id
    JOIN party_new n ON n.file_no = o.file_no
    """,
)
def _(t):
    from remap.operators.numbering import assign_ids

    periods = assign_ids(t.detail_old.select("detail_id", "event_date"), [F.col("detail_id").asc()])
    last = top_value(periods, "id", [F.col("event_date").desc(), F.col("detail_id").desc()])
    owned = attach_owner(t.detail_old, crosswalk(t.party_old, t.party_new))
    return with_scalar(owned.select("detail_id", "owner_id"), "period_id", last)


@query(
    "load_teams",
    """
    WITH tokens AS (
        SELECT trim(split_part(name, ',', 2)) AS name FROM team_dim WHERE name LIKE '%,%' GROUP BY 1
        UNION ALL SELECT 'Unassigned'),
    fresh AS (SELECT (SELECT coalesce(max(id), 0) FROM team_existing)
                     + row_number() OVER (ORDER BY k.name) AS id, k.name
              FROM tokens k WHERE NOT EXISTS (SELECT 1 FROM team_existing e WHERE e.name = k.name)),
    parents AS (SELECT id, name FROM team_existing UNION ALL SELECT id, name FROM fresh)
    SELECT d.id, d.code, p.id AS parent_id,
           CASE WHEN d.name LIKE '%,%' THEN trim(split_part(d.name, ',', 1)) ELSE d.name END AS name
    FROM team_dim d
    LEFT JOIN parents p ON p.name = CASE WHEN d.name = 'Unassigned' THEN 'Unassigned'
                                         WHEN d.name LIKE '%,%' THEN trim(split_part(d.name, ',', 2))
                                    END
    """,
)
def _(t):
    _, teams = split_teams(t.team_dim, t.team_existing, extra="Unassigned")
    return teams.select("id", "code", "parent_id", "name")


@query(
    "load_cascade",
    """
    SELECT d.detail_id, n.id AS owner_id, (SELECT count(*) FROM lineitem) AS lines_gone,
           (SELECT count(*) FROM orders) AS orders_gone
    FROM detail_old AS d, party_old AS o, party_new AS n
    WHERE d.old_id = o.old_id AND o.file_no = n.file_no
    """,
)
def _(t):
    path = new_path(t.spark, "cascade")
    rows = attach_owner(t.detail_old, crosswalk(t.party_old, t.party_new)).select("detail_id", "owner_id")
    t.lineitem.write.parquet(f"{path}/line")
    t.orders.select(F.col("o_orderkey").alias("detail_id"), F.col("o_custkey").alias("owner_id")).write.parquet(f"{path}/order")
    purged = loads.purge_ordered(t.spark, [("line", f"{path}/line"), ("order", f"{path}/order")])
    loads.append_load(rows, f"{path}/order", job="reload parents", table="order")
    gone = purged.groupBy().pivot("target_table", ["line", "order"]).agg(F.first("rows_deleted"))
    gone = gone.select(F.col("line").alias("lines_gone"), F.col("order").alias("orders_gone"))
    return t.spark.read.parquet(f"{path}/order").join(F.broadcast(gone))


@query(
    "load_batch",
    f"""
    SELECT CAST(1 AS bigint) AS id, CAST(11 AS bigint) AS stmt_id, 'load_open' AS job_name,
           '{RUN_AT}' AS run_at, 'success' AS status, CAST(0 AS bigint) AS delete_rows,
           count(*) AS insert_rows
    FROM detail_old d JOIN party_old o ON o.old_id = d.old_id JOIN party_new n ON n.file_no = o.file_no
    WHERE d.action = 'OPEN'
    UNION ALL
    SELECT 2, 12, 'load_failing', '{RUN_AT}', 'error', NULL, NULL
    UNION ALL
    SELECT 3, 13, 'load_failing', '{RUN_AT}', 'error', NULL, NULL
    UNION ALL
    SELECT 4, 11, 'load_open', '{RUN_AT}', 'success',
           (SELECT count(*) FROM detail_old d JOIN party_old o ON o.old_id = d.old_id
            JOIN party_new n ON n.file_no = o.file_no WHERE d.action = 'OPEN'),
           (SELECT count(*) FROM detail_old d JOIN party_old o ON o.old_id = d.old_id
            JOIN party_new n ON n.file_no = o.file_no WHERE d.action = 'OPEN')
    """,
)
def _(t):
    path = new_path(t.spark, "batch")
    owners = OwnerLink(shared_crosswalk(crosswalk(t.party_old, t.party_new)))

    def spec(target, **more):
        columns = [("detail_id", "detail_id"), ("owner_id", "owner_id")]
        return LoadSpec(target, t.detail_old, columns, _AUDIT, owner=owners, **more)

    opened = spec("open", where="action = 'OPEN'", ids=True)
    failing = spec("failing", where=F.assert_true(F.col("detail_id") < 0).isNull())
    adding = spec("failing", where=F.assert_true(F.col("detail_id") < 0).isNull(), clear="append")
    jobs = [
        (11, opened, f"{path}/open"),
        (12, failing, f"{path}/failing"),
        (13, adding, f"{path}/failing"),
        (11, opened, f"{path}/open"),
    ]
    run_batch(t.spark, jobs, log_path=f"{path}/log", run_at=RUN_AT)
    return read_records(t.spark, f"{path}/log/history", HISTORY).select(
        "id", "stmt_id", "job_name", "run_at", "status", "delete_rows", "insert_rows"
    )


@query(
    "load_bucketed",
    """
    SELECT 'open' AS load, d.detail_id, n.id AS owner_id
    FROM detail_old d JOIN party_old o ON o.old_id = d.old_id JOIN party_new n ON n.file_no = o.file_no
    WHERE d.action = 'OPEN'
    UNION ALL
    SELECT 'other', d.detail_id, n.id
    FROM detail_old d JOIN party_old o ON o.old_id = d.old_id JOIN party_new n ON n.file_no = o.file_no
    WHERE d.action IS NULL OR d.action <> 'OPEN'
    """,
)
def _(t):
    """Two loads of one batch over details and crosswalk bucketed by owner: no exchange at the join."""
    from remap.operators.crosswalk import crosswalk
    from remap.plans.bucketed import attach_owner_bucketed, bucket_by_owner

    details, owners = bucket_by_owner(
        t.spark, t.detail_old.select("detail_id", "old_id", "action"), crosswalk(t.party_old, t.party_new))
    loads = [("open", F.col("action") == "OPEN"), ("other", F.col("action").isNull() | (F.col("action") != "OPEN"))]
    frames = [
        attach_owner_bucketed(details.where(where), owners).select(F.lit(name).alias("load"), "detail_id", "owner_id")
        for name, where in loads
    ]
    return frames[0].unionByName(frames[1])
