"""Job registry kept as CSV, one job per record, SQL text over several lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the registry file.
COLUMNS = [
    "id",
    "name",
    "source_connection_name",
    "target_connection_name",
    "source_table",
    "target_table",
    "sql_text",
]
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows; a row whose id is not a whole number is dropped."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    raw = spark.read.schema(schema).options(**_CSV, emptyValue="", nullValue="\u0000").csv(path)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS[1:]]
    return raw.select(F.trim("id").try_cast("bigint").alias("id"), *text).where("id IS NOT NULL")


def write_registry(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write registry rows with every field quoted."""
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COLUMNS])
    out.write.mode(mode).options(header="true", quoteAll="true", quote='"', escape='"').csv(path)
