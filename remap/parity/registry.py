"""Registry of queries and twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remap.parity.views import BASE, VIEWS, base_tables, with_views
from remap.session import prepare

RUN_AT = "2026-01-01 00:00:00"

_queries: dict[str, Callable[["Tables"], DataFrame]] = {}
_twins: dict[str, str] = {}
_schemas: dict[tuple[str, str], T.StructType] = {}


class Tables:
    """Base tables and input views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in BASE:
            raise AttributeError(name)
        frame = self._base(name) if name in BASE else self._view(name)
        setattr(self, name, frame)
        return frame

    def _base(self, name: str) -> DataFrame:
        """Base table; its schema is read from the file once per session."""
        path = f"{self.sf_dir}/{name}.parquet"
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _schemas:
            _schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[key]).parquet(path)

    def _view(self, name: str) -> DataFrame:
        used = {table: getattr(self, table) for table in base_tables(name)}
        return _zoneless(self.spark.sql(VIEWS[name], **used))


def _zoneless(df: DataFrame) -> DataFrame:
    """Truncating a time turns it into an instant; turn it back."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def query(name: str, sql: str | None):
    """Register a query under ``name`` with its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _queries:
            raise ValueError(f"query {name!r} registered twice")
        _queries[name] = fn
        if sql is not None:
            _twins[name] = with_views(sql.strip())
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_twins)
