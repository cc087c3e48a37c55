"""Batch logs continue their ids from a high-water file and keep day folders."""

from __future__ import annotations

import remap.plans.batch as batch
from remap.plans.batch import drop_days_before, run_batch
from remap.session import new_path
from remap.sources.runlog import HISTORY, read_records
from tests.helpers import rows
from tests.test_loads_sources import spec  # noqa: F401  (fixture)


def test_a_batch_reads_no_old_record(spark, spec, monkeypatch):  # noqa: F811
    path = new_path(spark, "batch")
    jobs = [(n, spec, f"{path}/t{n}") for n in range(1, 4)]
    run_batch(spark, jobs, log_path=f"{path}/log", run_at="2026-01-01 09:00:00")

    def refuse(*_):
        raise AssertionError("an old log was read")

    monkeypatch.setattr(batch, "read_records", refuse)
    run_batch(spark, jobs * 4, log_path=f"{path}/log", run_at="2026-01-02 09:00:00")
    monkeypatch.undo()
    history = read_records(spark, f"{path}/log/history", HISTORY)
    assert sorted(r.id for r in history.select("id").collect()) == list(range(1, 16))


def test_retention_drops_whole_days(spark, spec):  # noqa: F811
    path = new_path(spark, "batch")
    for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
        run_batch(spark, [(1, spec, f"{path}/t")], log_path=f"{path}/log", run_at=f"{day} 09:00:00")
    assert drop_days_before(spark, f"{path}/log/history", "2026-01-03") == ["day=2026-01-01", "day=2026-01-02"]
    history = read_records(spark, f"{path}/log/history", HISTORY)
    assert rows(history.select("id")) == [(3,)]
    run_batch(spark, [(1, spec, f"{path}/t")], log_path=f"{path}/log", run_at="2026-01-03 10:00:00")
    assert rows(read_records(spark, f"{path}/log/history", HISTORY).select("id")) == [(3,), (4,)]
