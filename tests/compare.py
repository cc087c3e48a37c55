"""Run queries against their SQL twins and report differences."""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb
import pandas as pd

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from remap.parity.views import BASE  # noqa: E402


def open_duckdb(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, (pd.Timestamp,)):
        return value.isoformat()
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, bool):
        return str(value)
    return str(value)


# Spark type names and the SQL engine's names for the same type.
_SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE",
    "decimal(38,2)": "DECIMAL(38,2)",
}


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None where rows, names, types and values agree, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    types = {c: t for c, t in df.dtypes}
    rows = [r.asDict() for r in df.collect()]
    rel = con.sql(contract.oracle_sql()[name])
    columns = sorted(types)
    if columns != sorted(rel.columns):
        return f"columns {columns} != {sorted(rel.columns)}"
    other = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    bad = [f"{c}: {types[c]} / {other[c]}" for c in columns if _SAME.get(types[c]) != other[c]]
    if bad:
        return f"types {bad}"
    mine = sorted(tuple(_text(r[c]) for c in columns) for r in rows)
    at = {c: i for i, c in enumerate(rel.columns)}
    theirs = sorted(tuple(_text(r[at[c]]) for c in columns) for r in rel.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if mine != theirs:
        first = next((a, b) for a, b in zip(mine, theirs) if a != b)
        return f"{columns}: {first[0]} != {first[1]}"
    return None if mine else "EMPTY"


def main(sf_dir: str, names: list[str]) -> int:
    from tests.conftest import make_session

    spark = make_session()
    con = open_duckdb(sf_dir)
    failed = 0
    for name in names or list(contract.queries()):
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as err:  # report and go on
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
