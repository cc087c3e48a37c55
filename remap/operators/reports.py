"""Reports over the run log, delete ledger and activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remap.functions.dates import age_cutoff_parse
from remap.operators.numbering import first_per_key, number_rows
from remap.operators.sizing import settled


def _newest_first(run_at: str, tie: str) -> list[Column]:
    """Newest run first; runs of the same second: the one logged last."""
    return [F.col(run_at).desc_nulls_last(), F.col(tie).desc_nulls_last()]


def latest_per_job(
    runs: DataFrame, *, job: str = "job_id", run_at: str = "run_at", tie: str = "id"
) -> DataFrame:
    return first_per_key(runs, [job], _newest_first(run_at, tie))


def latest_errors(runs: DataFrame, **names: str) -> DataFrame:
    """Jobs whose last run failed: latest run per job first, then the filter."""
    return latest_per_job(runs, **names).where(F.col("status") == "error")


def latest_successes(runs: DataFrame, **names: str) -> DataFrame:
    """Last successful run per job: filter first, so a later failure hides nothing."""
    return latest_per_job(runs.where(F.col("status") == "success"), **names)


def history_by_job(
    runs: DataFrame, *, job: str = "job_id", run_at: str = "run_at", tie: str = "id",
    output: str = "position",
) -> DataFrame:
    """Each job's runs numbered newest first; equal times keep the log order.

    The log is sorted and written once with the columns it has, so project it first:
    its rows are narrow, and no join back to the log is needed.
    """
    order = [F.col(run_at).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    return number_rows(runs, order, within=[job], output=output)


def newest_first(
    df: DataFrame, *, run_at: str = "run_at", tie: str = "id", output: str = "position"
) -> DataFrame:
    """Whole log numbered newest first; equal times keep the log order."""
    order = [F.col(run_at).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    return number_rows(df, order, output=output)


def search(df: DataFrame, keyword: str, columns: list[str], joined: bool = False) -> DataFrame:
    """Rows where the keyword occurs, ignoring case; a blank keyword keeps all.

    ``joined`` searches one text of all columns separated by spaces, otherwise
    each column on its own.
    """
    needle = keyword.strip().lower()
    if not needle:
        return df
    texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    if joined:
        return df.where(F.concat_ws(" ", *texts).contains(needle))
    hit = F.lit(False)
    for t in texts:
        hit = hit | t.contains(needle)
    return df.where(hit)


def keep_recent(df: DataFrame, now: str, *, hours: int = 24, run_at: str = "run_at") -> DataFrame:
    """Drop log rows older than ``hours``; rows whose time cannot be read stay."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    when = age_cutoff_parse(run_at)
    return df.where(when.isNull() | (when >= cutoff))


def tail(df: DataFrame, n: int, *, sequence: str = "seq", user: str | None = None,
         user_column: str = "usr", most: int | None = None) -> DataFrame:
    """The last ``n`` rows in log order, then only those of ``user``.

    ``n`` below 1, or above ``most`` where that is given, is an error.

    The user filter comes after the limit on purpose: the report shows what of
    the latest rows belongs to that user.
    """
    if n < 1 or (most is not None and n > most):
        raise ValueError(f"a tail of {n} rows; allowed are 1 to {most or 'any number'}")
    last = df.orderBy(F.col(sequence).desc_nulls_last()).limit(n)
    if user:
        last = last.where(F.col(user_column) == user)
    return last.orderBy(F.col(sequence).asc_nulls_last())


def status_summary(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Total, success and error counts, for the whole log or per group."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
    )


def remaining(requested: DataFrame, finished: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids that did not finish yet, with success or with an error."""
    done = finished.where(F.col("status").isin("success", "error"))
    done = settled(done.select(F.col(key).alias("__done")).distinct(), "done")
    return requested.join(done, requested[key] == done["__done"], "left_anti")
