"""The exception queue, decisions and their replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import readings
from ..operators import cleaning as C
from ..operators import decisions as D
from ..operators import entities as E
from ..operators import questions as Q
from ..plans import exports as X
from ..plans.consolidate import consolidate, rebuild_affected, run
from ..schema import employee_schema
from ..session import fresh_path, stage
from ..streaming import queue
from . import query
from .cleaning import LOOKUP, RECORDS
from .matching import EXPORT_FINAL, REPORT
from .entities import TEXTS, linked, rows_of, texts
from .sql import (
    FIELDS, KEY_EMAIL, KEY_ID, conflicts_sql, days, dmy, enum, errors_of, iso, kept_sql, linked_sql, mdy, spelled, sq,
)
from .state import state, state_sql

SCHEMA = employee_schema()
ASKS_DATE = f"(field IN ('date_of_joining', 'date_of_birth') AND (len({days('kept_value')}) > 0 OR len({days('value')}) > 0))"


ESCALATED = (
    f"WITH RECURSIVE {RECORDS}, named_conflicts AS (SELECT natural_key, conflicts.* FROM conflicts JOIN gold ON gold.entity_id = conflicts.entity_id) "
    f"SELECT DISTINCT 'value_conflict' AS type, natural_key || ':' || field AS entity_ref, CAST(0 AS DOUBLE) AS confidence FROM named_conflicts WHERE NOT {ASKS_DATE} "
    f"UNION ALL SELECT DISTINCT 'ambiguous_date', field, 0 FROM named_conflicts WHERE {ASKS_DATE} "
    "UNION ALL SELECT 'manager_unresolved', natural_key, 0 FROM gold WHERE asks "
    "UNION ALL SELECT 'validation_failure', natural_key || ':' || field, 0 FROM bad "
    f"UNION ALL SELECT * FROM (WITH {EXPORT_FINAL} SELECT decision, file || ':' || catalog.header, CAST(match_confidence AS DOUBLE) / 1000 "
    "FROM catalog JOIN final ON catalog.header = final.header WHERE status = 'escalated')"
)


@query("build_escalations", ESCALATED)
def build_escalations(spark, sf_dir):
    """A whole run from the raw exports."""
    return run(spark, list(X.raw_exports(spark, sf_dir).items()), SCHEMA).questions.select("type", "entity_ref", "confidence")


ASKED = (
    f"WITH RECURSIVE {RECORDS}, named_conflicts AS (SELECT natural_key, conflicts.* FROM conflicts JOIN gold ON gold.entity_id = conflicts.entity_id), "
    f"plain AS (SELECT * FROM named_conflicts WHERE NOT {ASKS_DATE}), asked_dates AS (SELECT field, unnest([kept_value, value]) AS raw FROM named_conflicts WHERE {ASKS_DATE}), "
    "dates AS (SELECT DISTINCT field, raw FROM asked_dates), sampled AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5(raw), raw) AS pos FROM dates), "
    f"v AS (SELECT field, {sq('raw')} AS x FROM dates), reads AS (SELECT DISTINCT field, format, parsed FROM (SELECT field, 'iso' AS format, {iso('x')} AS parsed FROM v "
    f"UNION ALL SELECT field, 'dd/mm', {dmy('x')} FROM v UNION ALL SELECT field, 'mm/dd', {mdy('x')} FROM v UNION ALL SELECT field, 'text-month', {spelled('x')} FROM v) WHERE parsed IS NOT NULL)"
)


@query(
    "question_context",
    f"{ASKED}, told AS (SELECT 'value_conflict' AS type, natural_key || ':' || field AS entity_ref, unnest(['record', 'field', 'kept', 'kept_file', 'rivals']) AS key, "
    "unnest([natural_key, field, kept_value, kept_file, CAST(count(*) AS VARCHAR)]) AS value FROM plain GROUP BY natural_key, field, kept_value, kept_file "
    "UNION ALL SELECT 'manager_unresolved', natural_key, unnest(['record', 'manager_name']), unnest([natural_key, manager_email]) FROM gold WHERE asks "
    "UNION ALL SELECT 'validation_failure', natural_key || ':' || field, unnest(['record', 'field', 'value', 'error']), unnest([natural_key, field, value, error]) FROM bad "
    "UNION ALL SELECT 'ambiguous_date', field, unnest(['field', 'waiting', 'samples', 'formats']), unnest([field, CAST(waiting AS VARCHAR), samples, formats]) FROM ("
    "SELECT field, count(*) AS waiting, string_agg(raw, '|' ORDER BY pos) FILTER (WHERE pos <= 5) AS samples, "
    "(SELECT array_to_string(list_sort(list(DISTINCT format)), ',') FROM reads WHERE reads.field = sampled.field) AS formats FROM sampled GROUP BY field) "
    f"UNION ALL SELECT type, file || ':' || header, unnest(['source_column', 'file', 'samples']), unnest([header, file, samples]) FROM ({REPORT} SELECT * FROM report)) "
    "SELECT * FROM told WHERE value IS NOT NULL",
)
def question_context(spark, sf_dir):
    """What each question tells, in long form: samples of columns and dates, rivals, errors."""
    build = run(spark, list(X.raw_exports(spark, sf_dir).items()), SCHEMA)
    return build.questions.select("type", "entity_ref", F.explode("context").alias("key", "value"))


@query(
    "question_options",
    f"{ASKED}, offered AS (SELECT DISTINCT 'value_conflict' AS type, natural_key || ':' || field AS entity_ref, 0 AS rank, kept_value AS value, kept_file AS source, CAST(NULL AS DOUBLE) AS score FROM plain "
    "UNION ALL SELECT 'value_conflict', natural_key || ':' || field, CAST(place // 1000000000 AS INT) + 1, value, file, NULL FROM plain "
    "UNION ALL SELECT 'manager_unresolved', gold.natural_key, CAST(rank AS INT), key, 'lookup', CAST(matches.score AS DOUBLE) / 1000 FROM gold JOIN matches ON matches.value = manager_email WHERE asks "
    "UNION ALL SELECT DISTINCT 'ambiguous_date', field, 0, format, parsed, NULL FROM reads "
    f"UNION ALL SELECT * FROM (WITH {EXPORT_FINAL} SELECT decision, file || ':' || catalog.header, CAST(place - 1 AS INT), best.field, 'schema', CAST(best.score AS DOUBLE) / 1000 "
    "FROM catalog JOIN final ON catalog.header = final.header JOIN best ON best.header = catalog.header WHERE status = 'escalated')) SELECT * FROM offered",
)
def question_options(spark, sf_dir):
    """The answers on offer for every question of a run."""
    return run(spark, list(X.raw_exports(spark, sf_dir).items()), SCHEMA).options


KEY = ("run_id", "type", "entity_ref")


@query(
    "dedupe_open",
    f"WITH {state_sql('raised', 'questions')}, one AS (SELECT *, row_number() OVER (PARTITION BY run_id, type, entity_ref ORDER BY pos) AS rn FROM raised) "
    "SELECT run_id, type, entity_ref, pos, note FROM one WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM questions q WHERE q.status = 'open' "
    "AND q.run_id = one.run_id AND q.type = one.type AND q.entity_ref = one.entity_ref)",
)
def dedupe_open(spark, sf_dir):
    return Q.dedupe_open(state(spark, sf_dir, "raised"), state(spark, sf_dir, "questions"), "pos", KEY)


@query(
    "auto_close_stale",
    f"WITH {state_sql('raised', 'questions')}, marked AS (SELECT q.*, q.status = 'open' AND q.type IN ('value_conflict', 'validation_failure', 'ambiguous_date', "
    "'manager_unresolved') AND NOT EXISTS (SELECT 1 FROM raised r WHERE r.run_id = q.run_id AND r.type = q.type AND r.entity_ref = q.entity_ref) AS stale FROM questions q) "
    "SELECT id, run_id, type, entity_ref, CASE WHEN stale THEN 'resolved' ELSE status END AS status, CASE WHEN stale THEN 'agent' ELSE resolved_by END AS resolved_by FROM marked",
)
def auto_close_stale(spark, sf_dir):
    return Q.auto_close(state(spark, sf_dir, "questions"), state(spark, sf_dir, "raised"), KEY).select(
        "id", "run_id", "type", "entity_ref", "status", "resolved_by")


@query(
    "gate_status",
    f"WITH {state_sql('questions')} SELECT run_id, count(*) FILTER (WHERE status = 'open') AS open_questions, "
    "CASE WHEN count(*) FILTER (WHERE status = 'open') > 0 THEN 'awaiting_review' ELSE 'ready_to_push' END AS status FROM questions GROUP BY run_id",
)
def gate_status(spark, sf_dir):
    return Q.gate_status(state(spark, sf_dir, "questions"))


# Two builds of every run: what the first raises, who answers what, and what the second raises.
FIRST, SECOND, ANSWER = "pos % 5 <> 0", "pos % 7 < 4", "pos % 11 = 3"
TWO_BUILDS = (
    f"WITH {state_sql('raised')}, q1 AS (SELECT DISTINCT run_id, type, entity_ref FROM raised WHERE {FIRST}), "
    f"q2 AS (SELECT DISTINCT run_id, type, entity_ref FROM raised WHERE {SECOND}), a AS (SELECT DISTINCT run_id, type, entity_ref FROM raised WHERE {ANSWER}), "
    "built AS (SELECT DISTINCT run_id FROM q2), every AS (SELECT * FROM q1 UNION SELECT * FROM q2), marked AS (SELECT *, (run_id, type, entity_ref) IN (SELECT (run_id, type, entity_ref) FROM q1) AS one, "
    "(run_id, type, entity_ref) IN (SELECT (run_id, type, entity_ref) FROM q2) AS two, (run_id, type, entity_ref) IN (SELECT (run_id, type, entity_ref) FROM a) AS said, "
    "type IN ('value_conflict', 'validation_failure', 'ambiguous_date', 'manager_unresolved') AND run_id IN (SELECT run_id FROM built) AS closes FROM every) "
    "SELECT run_id, type, entity_ref, CASE WHEN two THEN 'open' WHEN said OR closes THEN 'resolved' ELSE 'open' END AS status, "
    "CASE WHEN two THEN NULL WHEN said THEN 'consultant' WHEN closes THEN 'agent' END AS resolved_by, "
    "CAST(one AS BIGINT) + CAST(two AND (NOT one OR said) AS BIGINT) AS opened FROM marked"
)


def queue_steps(spark, sf_dir):
    """(queue of the first build, answers to it, what the second build closed)."""
    before, given, after, last = queue_of_builds(spark, sf_dir)
    return before, given, Q.closed_by_agent(after, last)


def queue_of_builds(spark, sf_dir):
    raised = state(spark, sf_dir, "raised")
    none = spark.createDataFrame([], "run_id bigint, type string, entity_ref string, status string, resolved_by string, opened bigint")
    first = stage(Q.next_queue(none, raised.where(FIRST)), "queue")
    given = raised.where(ANSWER).selectExpr("*", "pos AS seq", "'resolved' AS status", "'consultant' AS resolved_by")
    after = stage(Q.answered(first, given)[0], "queue")
    return first, given, after, Q.next_queue(after, raised.where(SECOND))


@query("queue_after_builds", TWO_BUILDS)
def queue_after_builds(spark, sf_dir):
    """A stored queue through two builds with answers in between."""
    return queue_of_builds(spark, sf_dir)[-1]


@query("queue_stream", TWO_BUILDS)
def queue_stream(spark, sf_dir):
    """The same as keyed state of a stream, in two runs that share their checkpoint."""
    raised = state(spark, sf_dir, "raised")
    path, out, mark = (fresh_path(spark, f"queue-{n}") for n in ("events", "changes", "state"))

    def told(rows, seq, kind, who="CAST(NULL AS STRING)"):
        return rows.selectExpr("CAST(run_id AS BIGINT) AS run_id", f"{seq}L AS seq", f"'{kind}' AS kind", "type", "entity_ref", f"{who} AS resolved_by")

    def built(rows, seq):
        return told(rows.select("run_id", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("entity_ref")).distinct(), seq, "built")

    one, two = raised.where(FIRST), raised.where(SECOND)
    for part in (
        [told(one, 1, "raised"), built(one, 1), told(raised.where(ANSWER), 2, "resolved", "'consultant'")],
        [told(two, 3, "raised"), built(two, 3)],
    ):
        Q.union_all(part).coalesce(spark.sparkContext.defaultParallelism).write.mode("append").parquet(path)
        events = spark.readStream.schema(queue.EVENTS).parquet(path)
        queue.follow_queue(events, out, mark, spark.sparkContext.defaultParallelism).awaitTermination()
    return queue.queue_of(spark.read.schema(queue.CHANGES).parquet(out))


@query(
    "recheck_record",
    f"WITH {state_sql('records', 'questions')}, doubts AS (SELECT DISTINCT run_id, record FROM questions WHERE status = 'open') SELECT record_id, natural_key, "
    "CASE WHEN status = 'invalid' THEN 'invalid' WHEN (run_id, natural_key) IN (SELECT (run_id, record) FROM doubts) THEN 'needs_review' ELSE 'valid' END AS status FROM records",
)
def recheck_record(spark, sf_dir):
    return Q.recheck(state(spark, sf_dir, "records"), state(spark, sf_dir, "questions")).select("record_id", "natural_key", "status")


PENDING = f"pending AS (SELECT 'day_' || CAST(n % 3 AS STRING) AS field, raw FROM texts WHERE len({days('raw')}) > 1)"


@query(
    "date_question_rollup",
    f"WITH {TEXTS}, {PENDING}, v AS (SELECT field, {sq('raw')} AS x FROM pending), o AS (SELECT DISTINCT field, format, parsed FROM ("
    f"SELECT field, 'iso' AS format, {iso('x')} AS parsed FROM v UNION ALL SELECT field, 'dd/mm', {dmy('x')} FROM v UNION ALL "
    f"SELECT field, 'mm/dd', {mdy('x')} FROM v UNION ALL SELECT field, 'text-month', {spelled('x')} FROM v) WHERE parsed IS NOT NULL) "
    "SELECT field, waiting, samples, options, formats FROM (SELECT field, count(*) AS waiting, string_agg(raw, '|' ORDER BY pos) FILTER (WHERE pos <= 5) AS samples "
    "FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5(raw), raw) AS pos FROM (SELECT DISTINCT field, raw FROM pending)) GROUP BY field) "
    "JOIN (SELECT field, count(*) AS options, array_to_string(list_sort(list(DISTINCT format)), ',') AS formats FROM o GROUP BY field) USING (field)",
)
def date_question_rollup(spark, sf_dir):
    field = SCHEMA.fields[SCHEMA.names.index("date_of_joining")]
    named = texts(spark, sf_dir).withColumn(field.name, F.col("raw"))
    pending = named.where(C.is_ambiguous(field, F.col("raw"), {})).selectExpr("'day_' || CAST(n % 3 AS STRING) AS field", "raw")
    return Q.date_rollup(pending.withColumn("options", readings(F.col("raw"))))


# ---------------------------------------------------------------- decisions
MANUAL = {
    "action": "CASE p_size % 4 WHEN 0 THEN 'reject' ELSE 'correct' END",
    "value": (
        "CASE p_partkey % 7 WHEN 0 THEN '__drop__' WHEN 1 THEN NULL WHEN 2 THEN 'email' WHEN 3 THEN 'no_such_field' WHEN 4 THEN 'salary' "
        "WHEN 5 THEN '' ELSE 'phone' END"
    ),
}
COLUMNS = "p_brand AS file, 'col ' || CAST(p_partkey AS STRING) AS header"
NAMED = ", ".join(f"'{n}'" for n in SCHEMA.names)


@query(
    "decide_mapping_manual",
    f"WITH m AS (SELECT {COLUMNS}, p_partkey FROM part), d AS (SELECT {COLUMNS}, p_partkey AS id, {MANUAL['action']} AS action, {MANUAL['value']} AS value FROM part WHERE p_retailprice > 1000 "
    f"UNION ALL SELECT {COLUMNS}, p_partkey + 1000000000, 'correct', 'location' FROM part WHERE p_size > 40), "
    "l AS (SELECT file, header, arg_max(action, id) AS action, arg_max(coalesce(value, ''), id) AS value FROM d GROUP BY file, header), "
    "j AS (SELECT m.file, m.header, action, value, action IS NOT NULL AND (action = 'reject' OR value = '__drop__') AS dropped FROM m LEFT JOIN l ON l.file = m.file AND l.header = m.header), "
    f"k AS (SELECT *, coalesce(action IS NOT NULL AND NOT dropped AND value IN ({NAMED}), false) AS picked FROM j) "
    "SELECT file, header, CASE WHEN picked THEN value END AS target_field, CASE WHEN picked THEN 'manual' ELSE 'fuzzy' END AS method, "
    "CAST(CASE WHEN picked THEN 1 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN dropped THEN 'rejected' WHEN picked THEN 'resolved' ELSE 'escalated' END AS status, "
    "false AS invalid FROM k UNION ALL "
    f"SELECT file, header, value, NULL, NULL, action, true FROM d WHERE action <> 'reject' AND coalesce(value, '') NOT IN ('__drop__', {NAMED})",
)
def decide_mapping_manual(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    mappings = part.selectExpr(
        *COLUMNS.split(", ", 1), "CAST(NULL AS STRING) AS target_field", "'fuzzy' AS method", "0.5D AS confidence", "'escalated' AS status")
    names = "'ambiguous_mapping' AS type", *COLUMNS.replace("header", "column").split(", ", 1)
    first = part.where("p_retailprice > 1000").selectExpr(*names, "p_partkey AS decision_id", *[f"{e} AS {c}" for c, e in MANUAL.items()])
    later = part.where("p_size > 40").selectExpr(*names, "p_partkey + 1000000000 AS decision_id", "'correct' AS action", "'location' AS value")
    given = first.unionByName(later)
    settled = D.apply_mapping_decisions(mappings, given, SCHEMA).withColumn("invalid", F.lit(False))
    wrong = D.invalid_targets(given, SCHEMA).select(
        "file", F.col("column").alias("header"), F.col("value").alias("target_field"), F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("double").alias("confidence"), F.col("action").alias("status"), F.lit(True).alias("invalid"))
    return settled.unionByName(wrong)


FORMATS = [
    "o_orderkey AS decision_id",
    "'ambiguous_date' AS type",
    "'f' || CAST(o_custkey AS STRING) AS field",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'reject' ELSE 'approve' END AS action",
    "CASE o_orderkey % 4 WHEN 0 THEN 'dd/mm' WHEN 1 THEN 'mm/dd' WHEN 2 THEN 'text-month' END AS value",
]


@query(
    "decide_date_format",
    f"WITH d AS (SELECT {', '.join(FORMATS)} FROM orders) SELECT field, CASE WHEN arg_max(action, decision_id) = 'reject' OR arg_max(coalesce(value, ''), decision_id) = '' "
    "THEN 'raw' ELSE arg_max(coalesce(value, ''), decision_id) END AS label FROM d GROUP BY field",
)
def decide_date_format(spark, sf_dir):
    return D.forced_formats(X.table(spark, sf_dir, "orders").selectExpr(*FORMATS))


ID_KEY = "'id:' || " + X.PK
MAIL_KEY = "'email:c' || CAST(k AS STRING) || '@acme.com'"
# (offset, type, key, field, action, value) per customer k.
GIVEN = [
    (1, "value_conflict", ID_KEY, "'department'", "CASE k % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'correct' ELSE 'reject' END",
     "CASE k % 3 WHEN 0 THEN 'Sales' WHEN 1 THEN 'Ops' END"),
    (2, "validation_failure", MAIL_KEY, "'date_of_birth'", "CASE WHEN k % 4 = 0 THEN 'reject' ELSE 'correct' END",
     "CASE WHEN k % 4 = 3 THEN NULL ELSE '1985-02-28' END"),
    (3, "manager_unresolved", ID_KEY, "NULL", "'correct'", "CASE WHEN k % 2 = 0 THEN 'boss@acme.com' END"),
    (4, "validation_failure", ID_KEY, "'employment_status'", "'correct'", "CASE WHEN k % 5 = 4 THEN 'Working' ELSE NULL END"),
    (5, "value_conflict", MAIL_KEY, "'department'", "'correct'", "CASE WHEN k % 7 = 1 THEN 'HQ' ELSE 'Head Office' END"),
]


def given_decisions(spark, sf_dir):
    people = X.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k")
    cells = F.array(*[
        F.struct(
            F.expr(f"k * 10 + {i}").alias("decision_id"), F.lit(t).alias("type"), F.expr(key).alias("key"),
            F.expr(field).cast("string").alias("field"), F.expr(action).alias("action"), F.expr(value).alias("value"))
        for i, t, key, field, action, value in GIVEN
    ])
    return people.select(F.explode(cells).alias("d")).select("d.*")


GIVEN_SQL = "given AS (" + " UNION ALL ".join(
    f"SELECT k * 10 + {i} AS decision_id, '{t}' AS type, {key} AS key, {'CAST(NULL AS VARCHAR)' if field == 'NULL' else field} AS field, {action} AS action, {value} AS value "
    "FROM (SELECT c_custkey AS k FROM customer)"
    for i, t, key, field, action, value in GIVEN
) + ")"
EDITS = (
    f"alias AS (SELECT DISTINCT {KEY_EMAIL} AS key, entity_id FROM linked UNION SELECT DISTINCT {KEY_ID}, entity_id FROM linked), "
    f"{GIVEN_SQL}, placed AS (SELECT entity_id, CASE WHEN type = 'manager_unresolved' THEN 'manager_email' ELSE field END AS field, decision_id, type, action, value "
    "FROM given JOIN alias ON given.key = alias.key), "
    "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY decision_id DESC) AS rn FROM placed) WHERE rn = 1), "
    "edits AS (SELECT entity_id, field, CASE WHEN type = 'manager_unresolved' THEN true WHEN type = 'value_conflict' THEN action <> 'reject' AND coalesce(value, '') <> '' "
    "ELSE action <> 'reject' AND value IS NOT NULL END AS sets, CASE WHEN type = 'manager_unresolved' AND coalesce(value, '') = '' THEN NULL ELSE value END AS value, "
    "type = 'validation_failure' AND action = 'reject' AS rejected, type FROM newest)"
)


def edits_of(spark, sf_dir, type_: str):
    keys = E.entity_keys(linked(spark, sf_dir), SCHEMA)
    return D.record_edits(given_decisions(spark, sf_dir).where(F.col("type") == type_), keys, SCHEMA)


def edit_query(name: str, type_: str) -> None:
    sql = EDITS.replace("FROM given JOIN alias ON given.key = alias.key", f"FROM given JOIN alias ON given.key = alias.key WHERE type = '{type_}'")

    @query(name, f"WITH RECURSIVE {linked_sql()}, {sql} SELECT entity_id, field, sets, value, rejected FROM edits")
    def run_edits(spark, sf_dir):
        return edits_of(spark, sf_dir, type_)


for query_name, decision_type in {
    "decide_value": "value_conflict", "decide_validation": "validation_failure", "decide_lookup": "manager_unresolved",
}.items():
    edit_query(query_name, decision_type)


def edited(field: str) -> str:
    hit = f"(SELECT any_value(value) FROM edits e WHERE e.entity_id = cleaned.entity_id AND e.field = '{field}' AND e.sets)"
    has = f"EXISTS (SELECT 1 FROM edits e WHERE e.entity_id = cleaned.entity_id AND e.field = '{field}' AND e.sets)"
    v = f"CASE WHEN {has} THEN {hit} ELSE {field} END"
    return f"coalesce({enum(v)}, {v}) AS {field}" if field == "employment_status" else f"{v} AS {field}"


REPLAYED = (
    LOOKUP[:LOOKUP.index("known AS (")] + f"{EDITS}, "
    f"replayed AS (SELECT entity_id, natural_key, n_rows, {', '.join(edited(f) if f in ('department', 'date_of_birth', 'manager_email', 'employment_status') else f for f in FIELDS)}, "
    "entity_id IN (SELECT entity_id FROM edits WHERE field = 'manager_email' AND sets) AS decided, "
    "entity_id IN (SELECT entity_id FROM edits WHERE rejected) AS rejected FROM cleaned), "
    + LOOKUP[LOOKUP.index("known AS ("):].replace("FROM cleaned WHERE", "FROM replayed WHERE NOT decided AND")
    .replace("SELECT cleaned.*, key, score, value IS NOT NULL AND score >= 900 AS sure, value IS NOT NULL AND score < 900 AS asks",
             "SELECT replayed.*, key, score, NOT decided AND value IS NOT NULL AND score >= 900 AS sure, NOT decided AND value IS NOT NULL AND score < 900 AS asks")
    .replace("FROM cleaned LEFT JOIN tops", "FROM replayed LEFT JOIN tops") + ", "
    + conflicts_sql()[len(kept_sql()) + 2:] + ", "
    "unsettled AS (SELECT * FROM conflicts WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.entity_id = conflicts.entity_id AND e.field = conflicts.field)), "
    f"gold AS (SELECT entity_id, natural_key, n_rows, {', '.join('CASE WHEN sure THEN key ELSE manager_email END AS manager_email' if f == 'manager_email' else f for f in FIELDS)}, asks, rejected FROM resolved), "
    f"bad AS (SELECT * FROM ({errors_of('gold', 'natural_key')}) WHERE field <> 'manager_email' OR contains(value, '@')), "
    "statuses AS (SELECT gold.*, CASE WHEN rejected THEN 'invalid' WHEN asks OR entity_id IN (SELECT entity_id FROM unsettled) OR natural_key IN (SELECT natural_key FROM bad) "
    "THEN 'needs_review' ELSE 'valid' END AS status FROM gold)"
)
REPLAY_SQL = f"WITH RECURSIVE {REPLAYED} SELECT natural_key, {', '.join(FIELDS)}, status FROM statuses"


@query("replay_overrides", REPLAY_SQL)
def replay_overrides(spark, sf_dir):
    """Rebuild everything with the stored decisions."""
    return consolidate(rows_of(spark, sf_dir), SCHEMA, given_decisions(spark, sf_dir)).records.select("natural_key", *FIELDS, "status")


@query("minimal_rebuild", REPLAY_SQL)
def minimal_rebuild(spark, sf_dir):
    """Build without decisions, then redo only the records they name: the same result."""
    first = consolidate(rows_of(spark, sf_dir), SCHEMA)
    return rebuild_affected(first, given_decisions(spark, sf_dir)).records.select("natural_key", *FIELDS, "status")


@query("rebuild_in_steps", REPLAY_SQL)
def rebuild_in_steps(spark, sf_dir):
    """Decisions that arrive in two batches give what they give at once."""
    given = given_decisions(spark, sf_dir)
    early = F.col("decision_id") % 2 == 0
    build = rebuild_affected(consolidate(rows_of(spark, sf_dir), SCHEMA), given.where(early))
    return rebuild_affected(build, given.where(~early)).records.select("natural_key", *FIELDS, "status")
