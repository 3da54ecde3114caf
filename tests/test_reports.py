"""Reads of stored tables are about every run."""

from __future__ import annotations

from datetime import date

import pytest

from tributary.catalogue import reports
from tributary.streaming import feeds


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Line items of three runs (suppliers)."""
    path = str(tmp_path_factory.mktemp("lines"))
    rows = [
        (o, 1, 100 + s, s, float(o % 2), flag, "O", date(2020, 1, o))
        for o, (s, flag) in enumerate([(7, "A"), (8, "A"), (9, "N"), (8, "A")], 1)
    ]
    spark.createDataFrame(
        rows,
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, "
        "l_linestatus string, l_shipdate date",
    ).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_list_records_of_all_runs(spark, lines):
    assert [(r["run_id"], r["record_id"]) for r in reports.list_records(spark, lines).collect()] == [(8, 21), (8, 41)]


def test_list_escalations_of_all_runs(spark, lines):
    assert [(r["run_id"], r["id"]) for r in reports.list_escalations(spark, lines).collect()] == [(7, 11), (8, 21), (8, 41)]


def test_audit_log_of_all_runs(spark, lines):
    assert [(r["run_id"], r["id"]) for r in reports.audit_log(spark, lines).collect()] == [(7, 11), (8, 21), (9, 31), (8, 41)]


def test_audit_of_many_runs_in_few_folders(spark, tmp_path):
    """Files follow the rows, not the runs; both appends are there."""
    path = str(tmp_path / "audit")
    for n in (1, 2):
        feeds.append_audit(spark.range(500).selectExpr("id AS run_id", f"{n} AS id"), path)
    assert len([p for p in (tmp_path / "audit").iterdir() if p.is_dir()]) <= feeds.RUN_BUCKETS
    assert spark.read.parquet(path).groupBy("run_id").count().where("count = 2").count() == 500


def test_what_is_delivered_twice_is_worked_out_once(spark, monkeypatch):
    def rows(action):
        none = "CAST(NULL AS map<string,string>)"
        return spark.range(3).selectExpr(
            "1L AS run_id", "'agent' AS actor", f"'{action}' AS action", "'record' AS target_type", "CAST(id AS STRING) AS target_id",
            "'because' AS reason", f"{none} AS before", f"{none} AS after")

    class Build:
        def audit(self, run_id):
            return rows("cleaned_value")

        def activity(self, run_id):
            return rows("activity:mapping")

    subjects = spark.range(3).selectExpr("1L AS run_id", "'value_conflict' AS type", "'r' || id AS entity_ref", "'open' AS status", "'n' AS note", "'ann' AS resolved_by")
    monkeypatch.setattr(reports.consolidate, "run", lambda *a: Build())
    monkeypatch.setattr(reports.X, "raw_exports", lambda *a: {})
    monkeypatch.setattr(reports, "queue_steps", lambda *a: (subjects, subjects, subjects))
    monkeypatch.setattr(reports, "outcomes", lambda *a: (rows("pushed"), rows("rolled_back")))
    plans = []
    append = feeds.AuditTrail.append

    def noting(self, given, *a):
        plans.append(given._jdf.queryExecution().optimizedPlan().toString())
        append(self, given, *a)

    monkeypatch.setattr(feeds.AuditTrail, "append", noting)
    told = {r["action"]: r["n"] for r in reports.audit_trail(spark, "").collect()}
    assert told == {
        "cleaned_value": 3, "activity:mapping": 3, "resolved_value_conflict": 3, "auto_closed_escalation": 3, "pushed": 3, "rolled_back": 3}
    assert len(plans) == 12 and not any("Range" in p for p in plans)
