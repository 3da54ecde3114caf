"""A whole run over three small exports, decisions, rebuilds and delivery."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tributary.operators import decisions as D
from tributary.operators import delivery as V
from tributary.operators import questions as Q
from tributary.plans.consolidate import rebuild_affected, run
from tributary.session import fresh_path
from tributary.sources.readers import null_tokens
from tributary.streaming.feeds import StoredTarget

# Three exports of a theatre's staff, made for these tests.
STAGE = """Staff ID|Full Name|Email|Department|Role|Joining Date|Birth Date|Manager Email|Location|Status
T7|Wanda Quill|wanda@stage.example|Lighting|Technician|2015-02-27|1979-12-30|boss@stage.example|Annex|inactive
T8|  Milo   Farrow |milo@stage.example|Sound|mixer|2018-07-19||boss@stage.example|Hall|ACTIVE
T9|Greta Boss|boss@stage.example|Direction|Director|2009-10-05|1966-01-17||Hall|Active
T10|Ivo Pell|not-an-address|Sound|Apprentice|2022-13-40|2001-04-09|milo@stage.example|Annex|on leave
T10|Ivo Pell|not-an-address|Sound|Apprentice|2022-13-40|2001-04-09|milo@stage.example|Annex|on leave"""
ROTA = """Employee Code|Name|Official Email|Mobile|Team|DOJ|Manager
8|Milo Farrow|milo@stage.example|(020) 555-0147|Music|07/19/2018|boss@stage.exampel
11|Nell Argyle|nell@stage.example|555 0199|Wardrobe|11/30/2020|Wanda Quill"""
FEES = """Staff ID|Contact|Annual Salary|Locker
T7|wanda@stage.example|31,250.50|green
T9|boss@stage.example|64000|blue
T12|olga@stage.example|n/k|red"""


def source(spark, text):
    head, *body = text.split("\n")
    columns = head.split("|")
    rows = [(*line.split("|"), i) for i, line in enumerate(body)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns) + ", row_idx bigint")
    return null_tokens(df, columns)


@pytest.fixture(scope="module")
def sources(spark):
    return [("stage", source(spark, STAGE)), ("rota", source(spark, ROTA)), ("fees", source(spark, FEES))]


@pytest.fixture(scope="module")
def first(spark, sources, schema):
    return run(spark, sources, schema)


def decisions(spark, rows, start=0):
    names = [c.split()[0] for c in D.SCHEMA.split(", ")]
    return spark.createDataFrame(
        [tuple({**r, "decision_id": i}.get(n) for n in names) for i, r in enumerate(rows, start)], D.SCHEMA)


def questions(build):
    return {(r["type"], r["entity_ref"]) for r in build.questions.select("type", "entity_ref").collect()}


def records_of(build):
    return {r["natural_key"]: r for r in build.records.collect()}


COLUMNS = {("ambiguous_mapping", "fees:Contact"), ("ambiguous_mapping", "fees:Locker")}
MILO, NELL, IVO, OLGA = "email:milo@stage.example", "email:nell@stage.example", "email:not-an-address", "id:12"


def test_first_run(first):
    assert first.mappings.where("status = 'auto_applied'").count() == 19
    open_columns = first.mappings.where("status = 'escalated'").collect()
    assert {(r["header"], r["candidates"][0]["field"], r["candidates"][0]["score"]) for r in open_columns} == {
        ("Contact", "phone", 571), ("Locker", "phone", 400)}
    assert questions(first) == COLUMNS | {
        ("value_conflict", f"{MILO}:department"), ("value_conflict", f"{MILO}:manager_email"), ("manager_unresolved", NELL),
        *{("validation_failure", f"{IVO}:{f}") for f in ("date_of_joining", "email")},
        *{("validation_failure", f"{OLGA}:{f}") for f in ("date_of_joining", "email", "full_name", "salary")},
    }
    records = records_of(first)
    assert {k for k, r in records.items() if r["status"] == "valid"} == {"email:boss@stage.example", "email:wanda@stage.example"}
    assert len(records) == 6 and sum(r["n_rows"] for r in records.values()) == 10
    milo = records[MILO]
    assert (milo["full_name"], milo["phone"], milo["job_title"], milo["employment_status"], milo["date_of_joining"]) == (
        "Milo Farrow", "0205550147", "Mixer", "active", "2018-07-19")
    assert milo["provenance"]["phone"]["file"] == "rota" and milo["provenance"]["job_title"]["file"] == "stage"
    assert records["email:wanda@stage.example"]["salary"] == "31250.50"


def test_options_and_audit(first):
    options = {(r["entity_ref"], r["value"], r["source"]) for r in first.options.where("type = 'value_conflict'").collect()}
    assert options == {
        (f"{MILO}:department", "Sound", "stage"), (f"{MILO}:department", "Music", "rota"),
        (f"{MILO}:manager_email", "boss@stage.example", "stage"), (f"{MILO}:manager_email", "boss@stage.exampel", "rota"),
    }
    names = {r["value"] for r in first.options.where("type = 'manager_unresolved'").collect()}
    assert len(names) == 3 and all(n.endswith("@stage.example") for n in names)
    counts = {r["action"]: r["count"] for r in first.audit(1).groupBy("action").count().collect()}
    assert counts["mapped_column"] == 19 and counts["escalated"] == len(questions(first))


def test_mapping_decision_moves_the_key_and_keeps_edits(spark, sources, schema):
    given = decisions(spark, [
        {"type": "validation_failure", "key": OLGA, "field": "location", "action": "correct", "value": "Foyer"},
        {"type": "ambiguous_mapping", "file": "fees", "column": "Contact", "action": "correct", "value": "email"},
        {"type": "ambiguous_mapping", "file": "fees", "column": "Locker", "action": "correct", "value": "nonsense"},
    ])
    build = run(spark, sources, schema, given)
    asked = questions(build)
    assert ("ambiguous_mapping", "fees:Locker") in asked and ("ambiguous_mapping", "fees:Contact") not in asked
    # The address is now the record's key; what was decided by its number stays with it.
    olga = records_of(build)["email:olga@stage.example"]
    assert olga["location"] == "Foyer" and olga["provenance"]["location"]["file"] == "human"
    assert [r["value"] for r in D.invalid_targets(given, schema).collect()] == ["nonsense"]


ANSWERS = [
    {"type": "value_conflict", "key": MILO, "field": "department", "action": "approve", "value": "Sound"},
    {"type": "value_conflict", "key": MILO, "field": "manager_email", "action": "approve", "value": "boss@stage.example"},
    {"type": "manager_unresolved", "key": NELL, "action": "correct", "value": "wanda@stage.example"},
    {"type": "validation_failure", "key": IVO, "field": "email", "action": "correct", "value": "ivo@stage.example"},
    {"type": "validation_failure", "key": IVO, "field": "date_of_joining", "action": "correct", "value": "2022-04-30"},
    {"type": "validation_failure", "key": OLGA, "field": "email", "action": "correct", "value": "olga@stage.example"},
    {"type": "validation_failure", "key": OLGA, "field": "full_name", "action": "correct", "value": "Olga Rhys"},
    {"type": "validation_failure", "key": OLGA, "field": "date_of_joining", "action": "correct", "value": "2024-01-08"},
    {"type": "validation_failure", "key": OLGA, "field": "salary", "action": "correct", "value": "28000"},
]
DROPPED = [{"type": t, "file": "fees", "column": c.split(":")[1], "action": "reject"} for t, c in sorted(COLUMNS)]


def same_records(a, b, schema):
    columns = ["natural_key", *schema.names, "status"]
    one, two = (sorted(map(tuple, x.records.select(columns).collect()), key=repr) for x in (a, b))
    assert one == two


def test_rebuilds_keep_earlier_decisions(spark, sources, schema, first):
    whole = run(spark, sources, schema, decisions(spark, [*ANSWERS, *DROPPED]))
    assert questions(whole) == set() and {r["status"] for r in whole.records.collect()} == {"valid"}
    # Only the named records made again, in three steps, one of which touches a record twice.
    steps = first
    for rows, start in ((ANSWERS[:4], 0), (ANSWERS[4:6], 4), (ANSWERS[6:], 6)):
        steps = rebuild_affected(steps, decisions(spark, rows, start))
    same_records(steps, whole, schema)
    # A decision on a column makes everything again, with all that was decided before.
    assert questions(steps) == COLUMNS
    full = rebuild_affected(steps, decisions(spark, DROPPED, len(ANSWERS)))
    same_records(full, whole, schema)
    assert questions(full) == set()
    # The newest decision on a field counts.
    again = rebuild_affected(full, decisions(spark, [{**ANSWERS[0], "value": "Music"}], 100))
    assert records_of(again)[MILO]["department"] == "Music" and records_of(again)[MILO]["manager_email"] == "boss@stage.example"


def test_delivery_and_rollback(spark, sources, schema):
    build = run(spark, sources, schema, decisions(spark, [*ANSWERS, *DROPPED]))
    records = build.records.select("natural_key", *schema.names, "status", F.lit(1).cast("bigint").alias("run_id"),
                                   F.xxhash64("natural_key").alias("record_id"))
    none = spark.createDataFrame([], "run_id bigint, record_id bigint, attempt bigint, status string, http_status int, error string")
    pushed = V.push(records, none, schema)
    summary = V.push_summary(pushed).first()
    # Olga's record has no department.
    assert (summary["pushed"], summary["failed"], summary["run_status"]) == (5, 1, "completed")
    assert [r["error"] for r in pushed.where("http_status = 422").collect()] == ["department is mandatory in target system"]
    results = V.result_rows(pushed)
    again = V.retry(pushed.select(records.columns), results, schema)
    assert V.retry_report(again).first().asDict() == {"run_id": 1, "retried": 1, "exhausted": 0, "still_failed": 1}

    target = StoredTarget(spark, schema)
    ok = V.target_rows(pushed.where("http_status = 200"), schema, F.lit(1))
    target.upsert(ok)
    once = sorted(r["pk_value"] for r in target.read().collect())
    StoredTarget(spark, schema, target.path).upsert(ok)  # delivering twice, after a restart, changes nothing
    assert sorted(r["pk_value"] for r in target.read().collect()) == once and len(once) == 5
    newer = ok.where("pk_value = 'T9'").withColumns({"owner_run": F.lit(2).cast("bigint"), "version": F.lit(2).cast("bigint")})
    StoredTarget(spark, schema, target.path).upsert(newer)  # another run delivers one of the records since
    marked = target.rollback(pushed)
    assert {r["status"] for r in marked.collect()} == {"rolled_back"} and marked.where("deleted").count() == 4
    assert [(r["pk_value"], r["owner_run"]) for r in target.read().collect()] == [("T9", 2)]
    assert target.compact(fresh_path(spark, "compacted")).read().count() == 1


def test_target_opens_only_the_buckets_of_a_batch(spark, schema, tmp_path):
    """Files of other buckets are broken on purpose: whoever reads them fails."""
    path = str(tmp_path / "target")
    target = StoredTarget(spark, schema, path, 8)
    rows = spark.range(60).select(
        *[(F.concat(F.lit("E"), "id") if n == schema.primary_key else F.lit("x")).alias(n) for n in schema.names],
        F.lit(1).cast("bigint").alias("run_id"), F.lit("pushed").alias("status"))
    target.upsert(V.target_rows(rows, schema, F.lit(1)))
    mine = rows.where(F.col(schema.primary_key).isin("E3", "E4"))
    keys = V.target_keys(mine, schema)
    own = target.buckets_of(keys)
    assert len(own) <= 2
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in tmp_path.rglob("part-*")}
    for name in files():
        if "bucket=" in name and int(name.split("=")[1].split("/")[0]) not in own:
            (tmp_path / "target" / name).write_bytes(b"broken")
    before = files()
    assert {r["pk_value"] for r in target.find(keys).collect()} == {"E3", "E4"}
    assert target.rollback(mine).where("deleted").count() == 2
    assert target.find(keys).count() == 0
    new = {n for n in files() if n not in before and "bucket=" in n}
    assert {int(n.split("=")[1].split("/")[0]) for n in new} == set(own) and all(files()[n] == t for n, t in before.items())


def test_questions_close_when_their_cause_is_gone(spark, first):
    queue = first.questions.select("type", "entity_ref", F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolved_by"))
    raised = first.questions.where("type <> 'validation_failure'").select("type", "entity_ref")
    closed = Q.auto_close(queue, raised).where("status = 'resolved'").collect()
    assert {r["type"] for r in closed} == {"validation_failure"} and {r["resolved_by"] for r in closed} == {"agent"}
    new = Q.dedupe_open(raised.withColumn("n", F.lit(1)), queue, "n")
    assert new.count() == 0


def test_decided_date_format(spark, schema):
    text = "Emp ID|Name|Work Email|DOJ\n" + "\n".join(f"E{i}|P{i}|p{i}@stage.example|0{i}-0{i + 1}-2023" for i in range(1, 6))
    files = [("legacy", source(spark, text))]
    open_run = run(spark, files, schema)
    assert ("ambiguous_date", "date_of_joining") in questions(open_run)
    assert {r["status"] for r in open_run.records.collect()} == {"needs_review"}
    assert not any(t == "validation_failure" for t, _ in questions(open_run))
    decided = run(spark, files, schema, decisions(spark, [
        {"type": "ambiguous_date", "field": "date_of_joining", "action": "approve", "value": "mm/dd"}]))
    assert questions(decided) == set()
    assert sorted(r["date_of_joining"] for r in decided.records.collect())[0] == "2023-01-02"


def test_queue_of_a_run_over_two_builds(spark, sources, schema, first):
    none = spark.createDataFrame([], "run_id bigint, type string, entity_ref string, status string, resolved_by string, opened bigint")
    queue, gate = first.settle(1, none)
    assert {(r["type"], r["entity_ref"]) for r in queue.where("status = 'open'").collect()} == questions(first)
    assert gate.first()["status"] == "awaiting_review"
    given = decisions(spark, [*ANSWERS, *DROPPED])
    taken, late = D.on_closed(given, queue.where("type <> 'ambiguous_mapping'"))
    assert taken.count() + late.count() == given.count() and {r["error"] for r in late.collect()} <= {"no open question"}
    build = run(spark, sources, schema, given)
    after, gate = build.settle(1, queue)
    # Everything was answered: record questions close by themselves, those on columns wait for their answer in the queue.
    left = {r["type"] for r in after.where("status = 'open'").collect()}
    assert left <= {"ambiguous_mapping", "unmapped_column"}
    closed = Q.closed_by_agent(queue, after)
    assert closed.count() > 0 and {r["resolved_by"] for r in closed.collect()} == {"agent"}
    again, _ = build.settle(1, after)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)
    stages = [r["action"] for r in build.activity(1).collect()]
    assert stages == ["activity:mapping", "activity:reconciling", "activity:cleaning", "activity:validating"]


def test_unknown_decisions_and_runs_are_refused(spark):
    given = decisions(spark, [{**ANSWERS[0], "action": "maybe"}, {**ANSWERS[1], "type": "other"}, ANSWERS[2]])
    assert [(r["decision_id"], r["error"]) for r in D.refused(given).orderBy("decision_id").collect()] == [
        (0, "unknown action"), (1, "unknown type of question")]
    assert [r["decision_id"] for r in D.taken(given).collect()] == [2]
    rows = spark.createDataFrame([(1,), (2,), (3,)], "run_id bigint")
    runs = spark.createDataFrame([(1, "completed"), (2, "ready_to_push")], "run_id bigint, status string")
    for step, may in {"push": [2], "retry": [1], "rollback": [1]}.items():
        allowed, refused = V.guard(rows, runs, step)
        assert [r["run_id"] for r in allowed.collect()] == may
        assert sorted(r["run_id"] for r in refused.collect()) == sorted({1, 2, 3} - set(may))
