"""Run several loads one after the other and keep their run records."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from remap.operators.changes import next_id
from remap.plans.spec import LoadSpec, run
from remap.sinks.files import exists
from remap.sinks.loads import LoadResult
from remap.sources.runlog import DELETE_LEDGER, HISTORY, RecordShape, read_records, write_records


def run_batch(
    spark: SparkSession,
    jobs: list[tuple[int, LoadSpec, str]],
    *,
    log_path: str,
    run_at: str,
    stop_on_error: bool = False,
) -> list[LoadResult]:
    """Load each (job id, spec, path) and log it.

    Every job leaves one history row when it ends, and one ledger row where it
    removed old rows.  A failed job does not stop the others unless
    ``stop_on_error``.
    """
    results = []
    for job_id, spec, path in jobs:
        result = run(spark, spec, path)
        results.append(result)
        _log(spark, log_path, job_id, result, run_at)
        if stop_on_error and result.status == "error":
            break
    return results


def _log(spark: SparkSession, log_path: str, job_id: int, r: LoadResult, run_at: str) -> None:
    """History and ledger of one job, written as the job ends."""
    _append(
        spark,
        f"{log_path}/history",
        HISTORY,
        "stmt_id bigint, job_name string, target_table string, status string, "
        "delete_rows bigint, insert_rows bigint, message string",
        [(job_id, r.job_name, r.target_table, r.status, r.delete_rows, r.insert_rows, r.message)],
        run_at,
    )
    if r.delete_rows is not None:
        _append(
            spark,
            f"{log_path}/ledger",
            DELETE_LEDGER,
            "stmt_id bigint, job_name string, target_connection_name string, target_table string, "
            "sql_delete string, rows_deleted bigint",
            [(job_id, r.job_name, "", r.target_table, f"DELETE FROM {r.target_table}", r.delete_rows)],
            run_at,
        )


def _append(
    spark: SparkSession, path: str, shape: RecordShape, schema: str, rows: list[tuple], run_at: str
) -> None:
    """Append records with ids that continue after the largest one, into the run's day folder.

    The largest id comes from the log's high-water file, so a job reads no old record.
    """
    if not rows:
        return
    start = high_water(spark, path, shape) + 1
    numbered = [(start + n, *row) for n, row in enumerate(rows)]
    frame = spark.createDataFrame(numbered, f"id bigint, {schema}")
    write_records(frame.withColumn("run_at", F.lit(run_at)), f"{path}/{DAY}={run_at[:10]}", shape)
    _set_high_water(spark, path, start + len(rows) - 1)


DAY = "day"


def high_water(spark: SparkSession, path: str, shape: RecordShape) -> int:
    """The largest id of a log, from its one-row ``_highwater`` file.

    A log written before that file existed is read once to find it.
    """
    mark = f"{path}/_highwater"
    if exists(spark, mark):
        return int(spark.read.schema("id bigint").json(mark).first()["id"])
    if exists(spark, path):
        return int(next_id(read_records(spark, path, shape)).first()[0]) - 1
    return 0


def _set_high_water(spark: SparkSession, path: str, largest: int) -> None:
    spark.createDataFrame([(largest,)], "id bigint").coalesce(1).write.mode("overwrite").json(f"{path}/_highwater")


def drop_days_before(spark: SparkSession, path: str, day: str) -> list[str]:
    """Retention by folder: delete the day folders of a log older than ``day`` (YYYY-MM-DD)."""
    from remap.sinks.files import _fs, remove

    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return []
    gone = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(f"{DAY}=") and name[len(DAY) + 1 :] < day:
            remove(spark, f"{path}/{name}")
            gone.append(name)
    return sorted(gone)
