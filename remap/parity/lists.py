"""Code list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.functions.lists import split_codes, zip_pairs
from remap.operators.codelists import codes_to_ids, explode_codes, explode_rows
from remap.operators.lookup import CodeDim, Role, resolve_codes
from remap.parity.registry import query


def _tokens(delimiters: str) -> str:
    """SQL text: trimmed, non-blank tokens of the code list with their position."""
    return f"""
        SELECT detail_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS position
        FROM (SELECT detail_id,
                     list_filter(list_transform(
                         regexp_split_to_array(code_list, '[{delimiters}]'),
                         lambda s: trim(s)), lambda s: s <> '') AS codes
              FROM detail_old) x"""


@query("explode_codes", f"SELECT * FROM ({_tokens(',;')}) e")
def _(t):
    return explode_codes(t.detail_old, "code_list", keep=["detail_id"], delimiters=",;")


@query(
    "codes_to_ids",
    f"""
    SELECT d.detail_id, f.id_list
    FROM detail_old d
    LEFT JOIN (SELECT e.detail_id,
                      string_agg(CAST(c.id AS string), ',' ORDER BY e.position) AS id_list
               FROM ({_tokens(';')}) e
               JOIN code_dim c ON trim(c.code) = e.code AND coalesce(c.is_deleted, 0) = 0
               GROUP BY 1) f ON f.detail_id = d.detail_id
    """,
)
def _(t):
    dim = CodeDim(t.code_dim, deleted="lenient", normalise=True)
    out = codes_to_ids(t.detail_old, "code_list", dim, output="id_list")
    return out.select("detail_id", "id_list")


@query(
    "codes_to_ids_in_place",
    f"""
    SELECT d.detail_id, f.id_list AS code_list, d.old_id, size.path
    FROM detail_old d CROSS JOIN (VALUES ('constant'), ('join')) size(path)
    LEFT JOIN (SELECT e.detail_id,
                      string_agg(CAST(c.id AS string), ',' ORDER BY e.position) AS id_list
               FROM ({_tokens(';')}) e
               JOIN code_dim c ON trim(c.code) = e.code AND coalesce(c.is_deleted, 0) = 0
               GROUP BY 1) f ON f.detail_id = d.detail_id
    """,
)
def _(t):
    """The same list rewritten in place by both paths."""
    dim = CodeDim(t.code_dim, deleted="lenient", normalise=True)
    rows = t.detail_old.select("detail_id", "code_list", "old_id")
    small, large = (
        codes_to_ids(rows, "code_list", dim, output="code_list", fold_rows=n).withColumn("path", F.lit(name))
        for n, name in ((dim.rows, "constant"), (0, "join"))
    )
    return small.union(large)


@query(
    "codes_to_ids_bracketed",
    f"""
    SELECT d.detail_id, '[' || coalesce(f.id_list, '') || ']' AS id_list,
           '[' || coalesce(CAST(a.id AS string), '') || ']' AS one_id
    FROM detail_old d
    LEFT JOIN (SELECT e.detail_id,
                      string_agg(CAST(c.id AS string), ',' ORDER BY e.position) AS id_list
               FROM ({_tokens(',;')}) e LEFT JOIN code_dim c ON trim(c.code) = e.code
               GROUP BY 1) f ON f.detail_id = d.detail_id
    LEFT JOIN code_dim a ON a.code = d.code_a
    """,
)
def _(t):
    from remap.functions.lists import bracketed

    dim = CodeDim(t.code_dim, normalise=True)
    out = codes_to_ids(
        t.detail_old, "code_list", dim, output="id_list", delimiters=",;", form="bracketed"
    )
    out = resolve_codes(out, [Role("code_a", CodeDim(t.code_dim), {"a_id": "id"})])
    return out.select("detail_id", "id_list", bracketed("a_id").alias("one_id"))


@query(
    "codes_to_ids_by_id",
    """
    WITH lists AS (SELECT DISTINCT code_list FROM detail_old WHERE code_list <> ''),
    codes AS (SELECT DISTINCT l.code_list, c.id
              FROM (SELECT code_list, unnest(string_split(code_list, ';')) AS code FROM lists) l
              JOIN part_dim c ON c.code = l.code),
    ids AS (SELECT code_list, '[' || string_agg(CAST(id AS string), ',' ORDER BY id) || ']' AS s
            FROM codes GROUP BY 1)
    SELECT d.detail_id, i.s AS id_list
    FROM detail_old d LEFT JOIN ids i ON i.code_list = d.code_list
    """,
)
def _(t):
    # The large code table takes the path over distinct lists.
    dim = CodeDim(t.part_dim)
    out = codes_to_ids(
        t.detail_old, "code_list", dim, output="id_list", by_id=True, trim=False, fold_rows=0
    )
    return out.select("detail_id", "id_list")


@query(
    "explode_rows_outer",
    """
    SELECT d.detail_id, x.code, c.id AS code_id
    FROM detail_old d
    LEFT JOIN (SELECT detail_id, unnest(list_filter(string_split(code_list, ';'),
                                                    lambda s: s <> '')) AS code
               FROM detail_old) x ON x.detail_id = d.detail_id
    LEFT JOIN code_dim c ON c.code = x.code
    """,
)
def _(t):
    rows = explode_rows(t.detail_old.select("detail_id", "code_list"), "code_list", output="code")
    out = resolve_codes(rows, [Role("code", CodeDim(t.code_dim), {"code_id": "id"})])
    return out.select("detail_id", "code", "code_id")


@query(
    "zip_pairs",
    """
    WITH parts AS (
        SELECT detail_id,
               list_filter(list_transform(string_split(coalesce(code_list, ''), ';'),
                                          lambda s: trim(s)), lambda s: s <> '') AS a,
               list_filter(list_transform(string_split(coalesce(duration_title, ''), ' '),
                                          lambda s: trim(s)), lambda s: s <> '') AS b
        FROM detail_old),
    cut AS (SELECT detail_id, a, b, least(len(a), len(b)) AS n FROM parts)
    SELECT detail_id, unnest(range(1, n + 1)) AS position,
           unnest(a[1:n]) AS source_table, unnest(b[1:n]) AS target_table
    FROM cut
    """,
)
def _(t):
    pairs = zip_pairs(
        split_codes("code_list"), split_codes("duration_title", " "), ("source_table", "target_table")
    )
    out = t.detail_old.select("detail_id", F.posexplode(pairs).alias("p", "pair"))
    return out.select(
        "detail_id", (F.col("p") + 1).cast("bigint").alias("position"), "pair.source_table",
        "pair.target_table",
    )
