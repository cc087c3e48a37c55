"""Code and region lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from remap.operators.lookup import (
    CodeDim,
    Role,
    match_local_name,
    region_dim,
    region_table,
    resolve_codes,
    translate_region,
)
from remap.parity.registry import query

# Kind words in front of a place name.
PLACE_PREFIXES = ["Xã", "Phường"]


def local_name_sql(column: str) -> str:
    """SQL for a place name without its kind word: the rest after the first blank."""
    kinds = ", ".join(f"'{p.lower()}'" for p in PLACE_PREFIXES)
    name = f"trim({column})"
    return (
        f"CASE WHEN contains({name}, ' ') AND lower(split_part({name}, ' ', 1)) IN ({kinds}) "
        f"THEN ltrim(substr({name}, strpos({name}, ' '))) ELSE {name} END"
    )


@query(
    "lookup_star",
    """
    SELECT l.l_orderkey, l.l_linenumber, s.id AS supplier_id, p.id AS part_id,
           a.id AS line_code_id, b.id AS part_code_id, b.title AS part_code_title,
           c.id AS supplier_code_id
    FROM lineitem l
    LEFT JOIN supplier_dim s ON s.code = CAST(l.l_suppkey AS string)
    LEFT JOIN part_dim p ON p.code = CAST(l.l_partkey AS string) AND p.is_deleted = 0
    LEFT JOIN code_dim a ON a.code = CAST(l.l_linenumber AS string)
    LEFT JOIN code_dim b ON b.code = CAST(l.l_partkey % 30 AS string)
                        AND coalesce(b.is_deleted, 0) = 0
    LEFT JOIN code_dim c ON c.code = CAST(l.l_suppkey % 30 AS string)
    """,
)
def _(t):
    suppliers = CodeDim(t.supplier_dim)
    parts = CodeDim(t.part_dim, deleted="strict")
    codes = CodeDim(t.code_dim)
    live = CodeDim(t.code_dim, values=("id", "title"), deleted="lenient")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    out = resolve_codes(
        rows,
        [
            Role("l_suppkey", suppliers, {"supplier_id": "id"}),
            Role("l_partkey", parts, {"part_id": "id"}),
            Role("l_linenumber", codes, {"line_code_id": "id"}),
            Role(
                F.col("l_partkey") % 30,
                live,
                {"part_code_id": "id", "part_code_title": "title"},
            ),
            Role(F.col("l_suppkey") % 30, codes, {"supplier_code_id": "id"}),
        ],
    )
    return out.drop("l_suppkey", "l_partkey")


_ROLES = 7


@query(
    "lookup_role_playing",
    "SELECT d.detail_id, "
    + ", ".join(f"c{i}.id AS role_{i}_id" for i in range(1, _ROLES + 1))
    + " FROM detail_old d "
    + " ".join(
        f"LEFT JOIN code_dim c{i} ON c{i}.code = CAST((d.detail_id * {i}) % 27 AS string)"
        for i in range(1, _ROLES + 1)
    ),
)
def _(t):
    codes = CodeDim(t.code_dim)
    roles = [
        Role((F.col("detail_id") * i) % 27, codes, {f"role_{i}_id": "id"})
        for i in range(1, _ROLES + 1)
    ]
    return resolve_codes(t.detail_old.select("detail_id"), roles)


@query(
    "lookup_required",
    """
    SELECT d.detail_id, a.id AS code_a_id, b.id AS code_b_id
    FROM detail_old d
    JOIN code_dim a ON a.code = d.code_a
    JOIN code_dim b ON b.code = trim(d.code_b)
    """,
)
def _(t):
    plain, trimmed = CodeDim(t.code_dim), CodeDim(t.code_dim, normalise=True)
    out = resolve_codes(
        t.detail_old,
        [
            Role("code_a", plain, {"code_a_id": "id"}, required=True),
            Role("code_b", trimmed, {"code_b_id": "id"}, required=True),
        ],
    )
    return out.select("detail_id", "code_a_id", "code_b_id")


def _soft_delete(t, rule):
    dim = CodeDim(t.code_dim, deleted=rule)
    out = resolve_codes(t.detail_old, [Role("code_a", dim, {"code_a_id": "id"})])
    return out.select("detail_id", "code_a", "code_a_id")


@query(
    "lookup_soft_delete_strict",
    """
    SELECT d.detail_id, d.code_a, c.id AS code_a_id
    FROM detail_old d LEFT JOIN code_dim c ON d.code_a = c.code AND c.is_deleted = 0
    """,
)
def _(t):
    return _soft_delete(t, "strict")


@query(
    "lookup_soft_delete_lenient",
    """
    SELECT d.detail_id, d.code_a, c.id AS code_a_id
    FROM detail_old d LEFT JOIN code_dim c ON d.code_a = c.code AND coalesce(c.is_deleted, 0) = 0
    """,
)
def _(t):
    return _soft_delete(t, "lenient")


def regions(t) -> CodeDim:
    return region_dim(region_table(t.region_map, t.region_new))


@query(
    "region_translate",
    """
    SELECT p.old_id, r.id AS region_id
    FROM party_old p
    LEFT JOIN region_map m ON trim(CAST(m.old_code AS string)) = trim(p.region_code_old)
    LEFT JOIN region_new r ON trim(m.new_code) = trim(r.code) AND coalesce(r.is_deleted, 0) = 0
    """,
)
def _(t):
    out = translate_region(t.party_old, regions(t), {"region_code_old": "region_id"})
    return out.select("old_id", "region_id")


@query(
    "join_normalised_key",
    """
    SELECT d.detail_id, d.code_b, n.n_name AS title
    FROM detail_old d LEFT JOIN nation n ON trim(CAST(n.n_nationkey AS string)) = trim(d.code_b)
    """,
)
def _(t):
    dim = CodeDim(t.nation, code="n_nationkey", values=("n_name",), normalise=True)
    out = resolve_codes(t.detail_old, [Role("code_b", dim, {"title": "n_name"})])
    return out.select("detail_id", "code_b", "title")


@query(
    "join_name_stripped",
    f"""
    WITH placed AS (
        SELECT p.old_id, p.ward_name, trim(m.new_code) AS region, {local_name_sql("p.ward_name")} AS local_name
        FROM party_old p LEFT JOIN region_map m ON trim(CAST(m.old_code AS string)) = trim(p.region_code_old)),
    ward AS (SELECT id, trim(region_code) AS region, {local_name_sql("name")} AS local_name FROM ward_new)
    SELECT old_id, ward_name, ward.id AS ward_id FROM placed LEFT JOIN ward USING (region, local_name)
    """,
)
def _(t):
    placed = resolve_codes(
        t.party_old, [Role("region_code_old", regions(t), {"region_new_code": "new_code"})]
    )
    out = match_local_name(
        placed,
        t.ward_new,
        name="ward_name",
        region="region_new_code",
        prefixes=PLACE_PREFIXES,
        output="ward_id",
    )
    return out.select("old_id", "ward_name", "ward_id")


@query(
    "join_number_key",
    """
    SELECT o.o_orderkey AS id, c.c_name AS by_decimal, c.c_name AS by_double, p.p_name AS by_price
    FROM orders o
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey
    LEFT JOIN part p ON p.p_partkey * 4 + 1 = o.o_custkey
    """,
)
def _(t):
    """Codes kept as text against numbers with and without a fraction."""
    codes = CodeDim(t.customer.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("id")))
    quarters = CodeDim(
        t.part.select(F.concat((F.col("p_partkey")).cast("string"), F.lit(".25")).alias("code"), F.col("p_name").alias("id"))
    )
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("decimal(12,2)").alias("d"),
        F.col("o_custkey").cast("double").alias("f"),
        (F.col("o_custkey") / 4).cast("decimal(14,4)").alias("q"),
    )
    roles = [Role("d", codes, {"by_decimal": "id"}), Role("f", codes, {"by_double": "id"}), Role("q", quarters, {"by_price": "id"})]
    return resolve_codes(rows, roles).select("id", "by_decimal", "by_double", "by_price")
