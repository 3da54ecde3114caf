"""What keeps the work of a query in proportion to its rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from tributary.catalogue import delivery as catalogue_delivery
from tributary.functions import dates as D
from tributary.functions import text as T
from tributary.operators import cleaning as C
from tributary.operators import decisions as DEC
from tributary.operators import entities as E
from tributary.operators import validation as V
from tributary.schema import parse_schema
from tributary.streaming import queue


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def people(spark, schema):
    rows = [
        ("r1", " E1 ", "Ann  Lee", "a @x.org", "05/06/2020", "1,000"), ("r2", None, " ", "b@x.org", "2020-1-5", "n/k"),
        ("r3", "E3", "Bo", None, "30/02/1985", None), ("r4", None, None, None, None, None),
    ]
    names = ["natural_key", "employee_id", "full_name", "email", "date_of_joining", "salary"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return df.withColumns({f.name: F.lit(None).cast("string") for f in schema if f.name not in names})


def test_entries_are_worked_out_once(spark, schema):
    """A plain explode puts a filter on the array's size below it, which holds the whole chain of steps again."""
    cleaned = C.clean_records(people(spark, schema), schema)
    checked = V.with_errors(cleaned, schema)
    waiting = V.without_pending(F.col("errors"), F.col("pending_dates"))
    errors = V.error_rows(checked.withColumn("errors", waiting))
    changes = C.change_log(cleaned)
    for df in (errors, changes):
        # The only filter comes after the entries, and looks at nothing but whether there is one.
        filters = re.findall(r"Filter (.*)", plan_of(df))
        assert [len(x) < 30 for x in filters] == [True]
    told = {(r["natural_key"], r["field"]) for r in errors.collect()}
    # A waiting date has no error; a record of nulls lacks what is required and has no change.
    assert ("r1", "date_of_joining") not in told and {("r3", "date_of_joining"), ("r2", "salary")} <= told
    assert {(r["natural_key"], r["field"], r["after"]) for r in changes.collect()} == {
        ("r1", "employee_id", "E1"), ("r1", "full_name", "Ann Lee"), ("r1", "email", "a@x.org"), ("r1", "salary", "1000"),
        ("r2", "date_of_joining", "2020-01-05"), ("r2", "full_name", ""),
    }


def test_readings_of_a_column_are_those_of_each_text(spark):
    texts = ["2020-1-5", "2020/01/05", "2020-01/05", "05-06-2020", " 6/6/2020 ", "13/02/2020", "02/13/2020", "30/02/1985", "1 May 2020", "1-may-2020",
             "1-may 2020", "0000-01-01", "", "  ", "2020-13-40", "2020-01-05 ", " 2020-01-05", "soon", None]
    rows = D.with_days(spark.createDataFrame([(t,) for t in texts], "v string"), {"d": "v"})
    v, d = F.col("v"), F.col("d")
    only = F.when(F.size(D.distinct_days(v)) == 1, D.distinct_days(v)[0])
    same = [
        D.only_day(d).eqNullSafe(only), D.two_days(d).eqNullSafe(F.size(D.distinct_days(v)) > 1),
        D.formats_in(d).eqNullSafe(D.readings(v)), D.label_of(d).eqNullSafe(D.sole_label(v)),
        *[D.day_under(d, x).eqNullSafe(D.read_as(v, x)) for x in D.LABELS],
    ]
    for r in rows.select("v", *[s.alias(f"s{i}") for i, s in enumerate(same)]).collect():
        assert all(r[1:]), r


def test_blanks_are_the_same_by_both_classes(spark):
    codes = spark.range(1, 0x10000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    odd = codes.where(F.col("c").rlike(f"^{T.BLANKS}$") != F.col("c").rlike(f"^[{T.BLANK}]$"))
    assert odd.count() == 0 and codes.where(F.col("c").rlike(f"^{T.BLANKS}$")).count() > 20


class Held:
    """State of a group that counts how often it is asked and told."""

    def __init__(self, value=None):
        self.value, self.asked, self.told = value, 0, 0

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.value, self.told = value, self.told + 1


def test_queue_state_is_read_and_written_once_a_group():
    def frame(rows):
        return pd.DataFrame(rows, columns=["run_id", *queue.EVENT], dtype=object)

    raised = [(1, 1, "raised", "value_conflict" if i % 2 else "unmapped_column", f"r{i}", None) for i in range(400)]
    state = Held()
    first = frame([(1, 1, "built", None, None, None), *raised, raised[7], (1, 2, "resolved", "value_conflict", "r1", "ann"), (1, 2, "resolved", "value_conflict", "none", "ann")])
    told = pd.concat(queue.advance((1, 3), iter([first[:100], first[100:]]), state))
    assert len(told) == 402 and (state.asked, state.told) == (0, 1)
    # r1 opens anew, r3 stays; the other record questions close, those on columns do not.
    again = frame([(1, 3, "built", None, None, None), (1, 3, "raised", "value_conflict", "r1", None), (1, 3, "raised", "value_conflict", "r3", None)])
    told = pd.concat(queue.advance((1, 3), iter([again]), state))
    assert (state.asked, state.told) == (1, 2) and len(told) == 200
    now = {x[1]: x[2:] for x in zip(*state.value, strict=True)}
    assert now["r1"] == ("open", None, 3, 2) and now["r3"] == ("open", None, 3, 1)
    assert now["r5"] == ("resolved", "agent", 1, 1) and now["r2"] == ("open", None, 1, 1)
    assert list(queue.advance((1, 3), iter([frame([])]), state)) == []


def test_many_runs_are_few_groups_of_the_queue(spark):
    """Runs share the groups that hold state, each still by itself; a run may be null."""
    runs = spark.range(20000).selectExpr(
        "IF(id = 7, NULL, id + 9007199254740993) AS run_id", "1L AS seq", "'raised' AS kind", "'value_conflict' AS type", "'r' || id % 3 AS entity_ref", "NULL AS resolved_by")
    dealt = queue.placed(runs.select(*[c.split()[0] for c in queue.EVENTS.split(", ")]))
    assert dealt.select("bucket", "part").distinct().count() <= 3 * (queue.RUN_BUCKETS + 1)
    assert dealt.where("bucket = -1").count() == 1
    columns = ["run_id", *queue.EVENT]
    state = Held()
    first = [(run, 1, "raised", "value_conflict", f"r{i}", None) for run in (5, 6) for i in range(3)] + [(5, 1, "built", None, None, None)]
    told = pd.concat(queue.advance_runs((2, 1), iter([pd.DataFrame(first, columns=columns)]), state))
    assert len(told) == 6 and set(told["status"]) == {"open"}
    # Only run 5 is built again: r1 stays open, its others close; those of run 6 are left alone.
    second = [(5, 2, "raised", "value_conflict", "r1", None), (5, 2, "built", None, None, None), (6, 2, "rejected", "value_conflict", "r0", "ann")]
    told = pd.concat(queue.advance_runs((2, 1), iter([pd.DataFrame(second, columns=columns)]), state))
    assert sorted((r.run_id, r.entity_ref, r.status, r.resolved_by) for r in told.itertuples()) == [
        (5, "r0", "resolved", "agent"), (5, "r1", "open", None), (5, "r2", "resolved", "agent"), (6, "r0", "rejected", "ann")]
    assert (state.asked, state.told) == (1, 2) and len(state.value[0]) == 6
    none = pd.concat(queue.advance_runs((-1, 1), iter([pd.DataFrame(first[:1], columns=columns)]), Held()))
    assert none["run_id"].isna().all()


def test_fingerprints_of_rows_do_not_travel_unless_a_decision_names_them(spark):
    """The keys that decisions name are many, their fingerprints few: rows need no shuffle to find those."""
    schema = parse_schema({"primary_key": "employee_id", "fields": {"employee_id": "string", "email": "email"}, "match_keys": ["email", "employee_id"]})
    linked = spark.range(2000).selectExpr(
        "'hr' AS file", "0 AS file_ord", "id AS row_idx", "CAST(id % 500 AS STRING) AS employee_id",
        "CASE WHEN id % 3 = 0 THEN 'p' || (id % 500) || '@x.org' END AS email", "'id:' || (id % 500) AS entity_id")
    wanted = spark.range(20000).selectExpr("'id:' || id AS key").union(
        spark.createDataFrame([("unmatched:hr:7",), ("email:p9@x.org",), (None,)], "key string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        found = E.entity_keys(linked, schema, wanted)
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins, depth = [], {}
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = {k: v for k, v in depth.items() if k < at} | {at: line}
        if "unmatched" in line:
            joins += [v for v in depth.values() if "Join" in v]
    assert joins and all("BroadcastHashJoin" in x for x in joins)
    rows = {tuple(r) for r in found.collect()}
    assert rows == {(f"id:{i}", f"id:{i}") for i in range(500)} | {("unmatched:hr:7", "id:7"), ("email:p9@x.org", "id:9")}


def test_match_keys_of_a_row_are_worked_out_once(spark):
    schema = parse_schema({"primary_key": "employee_id", "fields": {"employee_id": "string", "email": "email", "code": "string"},
                           "match_keys": ["email", "employee_id", "code"]})
    rows = spark.createDataFrame(
        [(" A@x.org\n", "E7", "k"), ("a@x.org", "7", " "), (None, "TBD", "k"), ("\u2003", "8", "K "), (None, None, None)],
        "email string, employee_id string, code string")
    edges = E.key_edges(rows.repartition(2), schema)
    assert {tuple(r) for r in edges.collect()} == {("id:7", "email:a@x.org"), ("email:a@x.org", "code:k")} | {("id:8", "code:k")}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2


def test_a_delivery_judges_the_records_of_its_own_runs_only(spark, tmp_path, monkeypatch):
    lines = spark.range(60).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "id % 9 AS l_suppkey", "CAST(1 AS INT) AS l_linenumber", "1.0D AS l_quantity", "'R' AS l_returnflag")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    judged, rules = [], catalogue_delivery.V.target_rules

    def counted(records, schema):
        judged.append(records.count())
        return rules(records, schema)

    monkeypatch.setattr(catalogue_delivery.V, "target_rules", counted)
    rows = catalogue_delivery.stored_target(spark, str(tmp_path)).collect()
    early = sum(i % 9 < 5 for i in range(60))
    assert judged == [early, 60 - early, 60 - early]
    assert {(r.pk_value, r.version) for r in rows} == {(f"E{p}", max(i for i in range(60) if i % 7 == p) * 10 + 1) for p in range(1, 7)}


def test_decisions_are_not_sent_whole_to_every_task(spark):
    schema = parse_schema({"primary_key": "employee_id", "fields": {"employee_id": "string", "email": "email"}, "match_keys": ["employee_id"]})
    given = spark.createDataFrame(
        [(1, "value_conflict", "id:1", "email", "correct", "a@x.org"), (2, "value_conflict", "id:1", "email", "correct", "b@x.org"),
         (3, "value_conflict", "id:9", "email", "correct", "c@x.org")],
        "decision_id bigint, type string, key string, field string, action string, value string")
    keys = spark.createDataFrame([("id:1", "e1"), ("id:2", "e2")], "key string, entity_id string")
    edits = DEC.record_edits(given, keys, schema)
    assert "Broadcast" not in edits._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in edits.collect()] == [("e1", "email", True, "b@x.org", False)]
