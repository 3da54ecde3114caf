"""Samples of columns."""

from __future__ import annotations

from tributary.operators import profiling


def test_samples_rank_few_rows(spark):
    """Only rows up to a bound on the sample's last place reach the window."""
    cells = spark.range(0, 20_000, 1, 4).selectExpr("'f' AS file", "'c' || id % 2 AS column", "20000 - id AS row_idx", "string(id) AS value")
    few = spark.createDataFrame([("f", "d", None, "x"), ("f", "d", 9, "z"), ("f", "d", 3, "y"), (None, "e", 1, "v")], "file string, column string, row_idx long, value string")
    got = profiling.column_samples(cells.unionByName(few), 3)
    assert sorted((r["column"], r["pos"], r["value"]) for r in got.collect()) == [
        ("c0", 1, "19998"), ("c0", 2, "19996"), ("c0", 3, "19994"), ("c1", 1, "19999"), ("c1", 2, "19997"), ("c1", 3, "19995"),
        ("d", 1, "x"), ("d", 2, "y"), ("d", 3, "z"), ("e", 1, "v")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(row_idx" in plan and "_last" in plan.split("Window", 1)[1]
