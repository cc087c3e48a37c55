"""The activity log as CSV, its extra data as JSON text in one column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the columns of the log, in file order.
SCHEMA = "seq bigint, run_at string, usr string, action string, status string, meta string"

# Quotes inside a field are doubled, and a field may hold line breaks.  A missing value
# is written without quotes, an empty text with them.
_FORMAT = {"header": "true", "quote": '"', "escape": '"', "nullValue": None, "emptyValue": '""'}


def _options() -> dict[str, str]:
    return {k: v for k, v in _FORMAT.items() if v is not None}


def write_activity(log: DataFrame, path: str, mode: str = "append") -> None:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    log.select(names).write.mode(mode).options(**_options()).csv(path)


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Typed log rows; a sequence that is no number is NULL."""
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
    return spark.read.schema(SCHEMA).options(**options).csv(path)
