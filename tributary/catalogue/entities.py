"""Entity resolution, source date orders and the merge of each entity's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import read_as, readings
from ..functions.text import digits
from ..operators import dates as D
from ..operators import entities as E
from ..operators import survivorship as S
from ..plans import exports as X
from ..schema import employee_schema
from ..session import stage
from ..streaming.feeds import StoredComponents
from . import query
from .sql import (
    DATE_FIELDS, KEY_EMAIL, KEY_ID, NATURAL, conflicts_sql, days, dmy, iso, kept_sql, label, linked_sql, mdy,
    read_as as read_as_sql, same, spelled, sq,
)

SCHEMA = employee_schema()
FIELDS = X.FIELDS


def rows_of(spark, sf_dir):
    return X.mapped_rows(spark, sf_dir, SCHEMA)


def dated(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return D.rewrite_dates(rows, stage(D.inferred_orders(rows, DATE_FIELDS), "orders"), SCHEMA)


def linked(spark, sf_dir):
    return stage(E.link_rows(dated(spark, sf_dir), SCHEMA), "linked")


# ---------------------------------------------------------------- keys and entities
@query("normalize_id", f"WITH {X.rows_sql()} SELECT file, row_idx, employee_id, regexp_replace(employee_id, '[^0-9]', '', 'g') AS normal FROM rows")
def normalize_id(spark, sf_dir):
    return rows_of(spark, sf_dir).select("file", "row_idx", "employee_id", digits(F.col("employee_id")).alias("normal"))


@query(
    "match_keys",
    f"WITH {X.rows_sql()} SELECT file, row_idx, key FROM (SELECT file, row_idx, {KEY_EMAIL} AS key FROM rows UNION ALL "
    f"SELECT file, row_idx, {KEY_ID} FROM rows) WHERE key IS NOT NULL",
)
def match_keys(spark, sf_dir):
    return rows_of(spark, sf_dir).select("file", "row_idx", F.explode(E.match_keys(SCHEMA)).alias("key"))


@query("link_entities", f"WITH RECURSIVE {linked_sql()} SELECT file, row_idx, entity_id FROM linked")
def link_entities(spark, sf_dir):
    return E.link_rows(rows_of(spark, sf_dir), SCHEMA).select("file", "row_idx", "entity_id")


@query("link_in_batches", f"WITH RECURSIVE {linked_sql()} SELECT file, row_idx, entity_id FROM linked")
def link_in_batches(spark, sf_dir):
    """Exports that come one after the other, each joined to the components stored so far: the same entities."""
    rows = rows_of(spark, sf_dir)
    store = StoredComponents(spark, buckets=8)
    for file in X.FILES:
        store.add(E.key_edges(rows.where(F.col("file") == file), SCHEMA))
    return E.link_rows(rows, SCHEMA, store.read()).select("file", "row_idx", "entity_id")


@query("unmatched_singletons", f"WITH RECURSIVE {linked_sql()} SELECT file, row_idx, entity_id, full_name FROM linked WHERE entity_id LIKE 'unmatched:%'")
def unmatched_singletons(spark, sf_dir):
    return E.link_rows(rows_of(spark, sf_dir), SCHEMA).where(F.col("entity_id").startswith("unmatched:")).select(
        "file", "row_idx", "entity_id", "full_name")


@query("natural_key", f"WITH RECURSIVE {kept_sql()} SELECT entity_id, {NATURAL} AS natural_key FROM kept")
def natural_key(spark, sf_dir):
    kept = S.keep_cells(E.link_rows(rows_of(spark, sf_dir), SCHEMA).select("entity_id", "file", "file_ord", "row_idx", *FIELDS), SCHEMA)
    return S.merged_records(kept, SCHEMA).select("entity_id", E.natural_key(SCHEMA).alias("natural_key"))


@query(
    "dedupe_exact_rows",
    f"WITH {X.rows_sql()} SELECT file, {', '.join(FIELDS)}, count(*) AS copies, min(row_idx) AS first_row "
    f"FROM rows GROUP BY file, {', '.join(FIELDS)} HAVING count(*) > 1",
)
def dedupe_exact_rows(spark, sf_dir):
    return E.duplicate_rows(rows_of(spark, sf_dir), FIELDS)


# ---------------------------------------------------------------- dates
MONTH3 = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(d) * 3 - 2, 3)"
MONTH = (
    "CASE month(d) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'april' WHEN 5 THEN 'May' "
    "WHEN 6 THEN 'June' WHEN 7 THEN 'JULY' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' "
    "WHEN 11 THEN 'November' ELSE 'December' END"
)
Y, MO, DA = "CAST(year(d) AS STRING)", "CAST(month(d) AS STRING)", "CAST(day(d) AS STRING)"
SPELLINGS = (
    f"CASE n % 14 WHEN 0 THEN {Y} || '-' || {MO} || '-' || {DA} WHEN 1 THEN {Y} || '/' || {X.two('month(d)')} || '/' || {X.two('day(d)')} "
    f"WHEN 2 THEN {DA} || '-' || {X.two('month(d)')} || '-' || {Y} WHEN 3 THEN ' ' || {DA} || '/' || {MO} || '/' || {Y} || ' ' "
    f"WHEN 4 THEN {MO} || '-' || {DA} || '-' || {Y} WHEN 5 THEN {X.two('month(d)')} || '/' || {X.two('day(d)')} || '/' || {Y} "
    f"WHEN 6 THEN {DA} || '-' || {MONTH3} || '-' || {Y} WHEN 7 THEN {DA} || ' ' || {MONTH} || ' ' || {Y} "
    f"WHEN 8 THEN '30/02/' || {Y} WHEN 9 THEN {DA} || '/' || {MO} || '/' || substr({Y}, 3, 2) "
    f"WHEN 10 THEN {DA} || '/' || {MO} || '-' || {Y} WHEN 11 THEN 'soon' WHEN 12 THEN {MO} || '/' || {MO} || '/' || {Y} "
    f"ELSE {DA} || '  ' || {MONTH3} || ' ' || {Y} END"
)
# One source per customer; each keeps to one convention, every fifth one mixes two.
BY_SOURCE = (
    f"CASE WHEN k % 5 = 0 THEN {DA} || '/' || {MO} || '/' || {Y} WHEN k % 5 = 1 THEN {MO} || '-' || {DA} || '-' || {Y} "
    f"WHEN k % 5 = 2 THEN {Y} || '-' || {MO} || '-' || {DA} WHEN k % 5 = 3 THEN {DA} || ' ' || {MONTH3} || ' ' || {Y} "
    f"WHEN n % 2 = 0 THEN {DA} || '-' || {MO} || '-' || {Y} ELSE {MO} || '/' || {DA} || '/' || {Y} END"
)
ORDERED = "o_orderkey AS n, o_custkey AS k, o_orderdate AS d"
TEXTS = f"texts AS (SELECT n, {SPELLINGS} AS raw FROM (SELECT {ORDERED} FROM orders))"
SOURCED = (
    f"sourced AS (SELECT 'src_' || CAST(k AS STRING) AS file, n AS row_idx, {BY_SOURCE} AS day FROM (SELECT {ORDERED} FROM orders)), "
    f"labels AS (SELECT file, min({label('day')}) AS label FROM sourced GROUP BY file HAVING min({label('day')}) = max({label('day')}))"
)


def texts(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").selectExpr(*ORDERED.split(", ")).selectExpr("n", f"{SPELLINGS} AS raw")


def sourced(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").selectExpr(*ORDERED.split(", ")).selectExpr(
        "'src_' || CAST(k AS STRING) AS file", "n AS row_idx", f"{BY_SOURCE} AS day")


@query(
    "date_candidates",
    f"WITH {TEXTS}, v AS (SELECT n, raw, {sq('raw')} AS x FROM texts), r AS (SELECT n, raw, 'iso' AS format, {iso('x')} AS parsed FROM v "
    f"UNION ALL SELECT n, raw, 'dd/mm', {dmy('x')} FROM v UNION ALL SELECT n, raw, 'mm/dd', {mdy('x')} FROM v "
    f"UNION ALL SELECT n, raw, 'text-month', {spelled('x')} FROM v) SELECT * FROM r WHERE parsed IS NOT NULL",
)
def date_candidates(spark, sf_dir):
    return texts(spark, sf_dir).select("n", "raw", F.explode(readings(F.col("raw"))).alias("r")).select("n", "raw", "r.*")


@query("infer_date_order", f"WITH {SOURCED} SELECT file, 'day' AS field, label FROM labels")
def infer_date_order(spark, sf_dir):
    return D.inferred_orders(sourced(spark, sf_dir), ["day"])


@query(
    "rewrite_dates",
    f"WITH {SOURCED} SELECT sourced.file, row_idx, day AS raw, coalesce(CASE WHEN label IS NOT NULL THEN {read_as_sql('day', 'label')} END, day) AS day "
    "FROM sourced LEFT JOIN labels ON sourced.file = labels.file",
)
def rewrite_dates(spark, sf_dir):
    rows = sourced(spark, sf_dir)
    orders = stage(D.inferred_orders(rows, ["day"]), "orders")
    joined = rows.join(orders.select("file", "label"), "file", "left")
    return joined.select("file", "row_idx", F.col("day").alias("raw"), D.rewritten(F.col("day"), F.col("label")).alias("day"))


FORCED = "CASE n % 3 WHEN 0 THEN 'dd/mm' WHEN 1 THEN 'mm/dd' ELSE 'text-month' END"


@query("forced_format", f"WITH {TEXTS} SELECT n, raw, {FORCED} AS label, {read_as_sql('raw', FORCED)} AS parsed FROM texts")
def forced_format(spark, sf_dir):
    return texts(spark, sf_dir).withColumn("label", F.expr(FORCED)).withColumn("parsed", read_as(F.col("raw"), F.col("label")))


# ---------------------------------------------------------------- merge
RAW = ", ".join(FIELDS)


def kept_of(spark, sf_dir):
    return S.keep_cells(E.link_rows(dated(spark, sf_dir), SCHEMA), SCHEMA)


@query("merge_first_non_blank", f"WITH RECURSIVE {kept_sql()} SELECT entity_id, n_rows, {RAW} FROM kept")
def merge_first_non_blank(spark, sf_dir):
    return S.merged_records(kept_of(spark, sf_dir), SCHEMA).select("entity_id", "n_rows", *FIELDS)


PROVENANCE = " UNION ALL ".join(
    f"SELECT entity_id, '{f}' AS field, {f}_file AS file, {f} AS raw FROM kept WHERE {f} IS NOT NULL" for f in FIELDS
)


@query("provenance", f"WITH RECURSIVE {kept_sql()} {PROVENANCE}")
def provenance(spark, sf_dir):
    return S.provenance_rows(S.merged_records(kept_of(spark, sf_dir), SCHEMA))


@query(
    "provenance_report",
    f"WITH RECURSIVE {kept_sql()}, p AS ({PROVENANCE}) SELECT field, file, count(*) AS records, count(DISTINCT raw) AS \"values\" FROM p GROUP BY ALL",
)
def provenance_report(spark, sf_dir):
    return S.provenance_rows(S.merged_records(kept_of(spark, sf_dir), SCHEMA)).groupBy("field", "file").agg(
        F.count("*").alias("records"), F.countDistinct("raw").alias("values"))


@query(
    "enrich_missing",
    f"WITH RECURSIVE {kept_sql()}, p AS ({PROVENANCE}) SELECT p.* FROM p JOIN kept ON p.entity_id = kept.entity_id WHERE p.file <> kept.origin_file",
)
def enrich_missing(spark, sf_dir):
    merged = S.merged_records(kept_of(spark, sf_dir), SCHEMA)
    return merged.select("entity_id", "origin_file", F.explode("provenance").alias("field", "source")).where(
        F.col("source.file") != F.col("origin_file")
    ).select("entity_id", "field", F.col("source.file").alias("file"), F.col("source.raw").alias("raw"))


@query(
    "prefer_conformant_email",
    f"WITH RECURSIVE {kept_sql()} SELECT entity_id, email_first AS first_value, email AS kept_value, email_file AS kept_file FROM kept WHERE email IS NOT NULL",
)
def prefer_conformant_email(spark, sf_dir):
    return kept_of(spark, sf_dir).where(F.col("email__kept").isNotNull()).select(
        "entity_id", F.col("email__first.raw").alias("first_value"), F.col("email__kept.raw").alias("kept_value"),
        F.col("email__kept.file").alias("kept_file"))


OTHER_DAY = (
    f"CASE n % 3 WHEN 0 THEN {DA} || '/' || {MO} || '/' || {Y} WHEN 1 THEN {Y} || '-' || {MO} || '-' || {DA} "
    f"ELSE {DA} || ' ' || {MONTH} || ' ' || {Y} END"
)
PAIR_COLS = {
    "date_of_joining": (SPELLINGS, OTHER_DAY),
    "employment_status": (
        "CASE n % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'on_leave' WHEN 2 THEN 'Resigned' ELSE 'Temp' END",
        "CASE n % 5 WHEN 0 THEN ' working' WHEN 1 THEN 'ON  LEAVE' WHEN 2 THEN 'exited' WHEN 3 THEN 'temp' ELSE 'a' END",
    ),
    "employee_id": (
        "'E' || lpad(CAST(k AS STRING), 6, '0')",
        "CASE n % 3 WHEN 0 THEN lpad(CAST(k AS STRING), 6, '0') WHEN 1 THEN CAST(k AS STRING) ELSE 'e' || lpad(CAST(k AS STRING), 6, '0') END",
    ),
    "email": (
        "CASE WHEN n % 3 = 0 THEN 'Name ' || CAST(k AS STRING) ELSE 'c' || CAST(k AS STRING) || '@acme.com' END",
        "CASE n % 4 WHEN 0 THEN 'C' || CAST(k AS STRING) || '@ACME.com ' WHEN 1 THEN 'p' || CAST(k AS STRING) || '@x.org' ELSE 'name  ' || CAST(k AS STRING) END",
    ),
    "full_name": ("'Ann  B' || CAST(n % 7 AS STRING)", "'ANN b' || CAST(n % 5 AS STRING) || ' '"),
}
PAIR_SELECT = ", ".join(f"{a} AS {f}_a, {b} AS {f}_b" for f, (a, b) in PAIR_COLS.items())


@query(
    "values_equivalent",
    f"WITH pairs AS (SELECT n, {PAIR_SELECT} FROM (SELECT {ORDERED} FROM orders)) "
    + " UNION ALL ".join(
        f"SELECT n, '{f}' AS field, {f}_a AS a, {f}_b AS b, {same(f, f + '_a', f + '_b')} AS same FROM pairs" for f in PAIR_COLS),
)
def values_equivalent(spark, sf_dir):
    base = X.table(spark, sf_dir, "orders").selectExpr(*ORDERED.split(", "))
    kinds = {f.name: f for f in SCHEMA}
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.expr(a).alias("a"), F.expr(b).alias("b"),
                 S.equivalent(kinds[f], F.expr(a), F.expr(b), SCHEMA).alias("same"))
        for f, (a, b) in PAIR_COLS.items()
    ])
    return base.select("n", F.explode(cells).alias("c")).select("n", "c.*")


def conflicts_of(spark, sf_dir):
    rows = linked(spark, sf_dir)
    kept = stage(S.keep_cells(rows, SCHEMA), "kept")
    return S.distinct_disagreements(S.disagreements(S.distinct_rows(rows, SCHEMA), kept, SCHEMA))


@query("value_conflicts", f"WITH RECURSIVE {conflicts_sql()} SELECT entity_id, field, kept_file, kept_value, file, value FROM conflicts")
def value_conflicts(spark, sf_dir):
    return conflicts_of(spark, sf_dir).select("entity_id", "field", "kept_file", "kept_value", "file", "value")


@query(
    "date_conflict_reroute",
    f"WITH RECURSIVE {conflicts_sql()} SELECT entity_id, field, kept_value, value, CASE WHEN field IN ('date_of_joining', 'date_of_birth') "
    f"AND (len({days('kept_value')}) > 0 OR len({days('value')}) > 0) THEN 'ambiguous_date' ELSE 'value_conflict' END AS type FROM conflicts",
)
def date_conflict_reroute(spark, sf_dir):
    return conflicts_of(spark, sf_dir).select(
        "entity_id", "field", "kept_value", "value",
        F.when(S.is_date_question(), "ambiguous_date").otherwise("value_conflict").alias("type"))
