"""Cleaning, automatic fixes, validation and reference lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import readings
from ..functions.text import literal_lookup, squeeze, title_case
from ..operators import cleaning as C
from ..operators import entities as E
from ..operators import lookup as L
from ..operators import survivorship as S
from ..operators import validation as V
from ..plans import exports as X
from ..plans.consolidate import consolidate, known_contacts
from ..schema import employee_schema
from ..session import stage
from . import query
from .entities import TEXTS, kept_of, rows_of, texts
from .sql import (
    DATE_FIELDS, EMAIL_FIELDS, FIELDS, TITLED, cleaned, cleaned_sql, conflicts_sql, days, dmy, enum, error, errors_of,
    iso, is_email, is_number, kept_sql, lcs_bits, mdy, per_mille, phone as phone_sql, spelled, sq, tidy, title, tokens,
)

SCHEMA = employee_schema()
BY_NAME = {f.name: f for f in SCHEMA}


def merged_of(spark, sf_dir):
    return S.merged_records(kept_of(spark, sf_dir), SCHEMA).withColumn("natural_key", E.natural_key(SCHEMA))


@query("clean_whitespace", f"WITH {X.rows_sql()} SELECT file, row_idx, {', '.join(f'{sq(f)} AS {f}' for f in FIELDS)} FROM rows")
def clean_whitespace(spark, sf_dir):
    return rows_of(spark, sf_dir).select("file", "row_idx", *[squeeze(F.col(f)).alias(f) for f in FIELDS])


@query("title_case", f"WITH {X.rows_sql()} SELECT file, row_idx, {', '.join(f'{title(f)} AS {f}' for f in TITLED)} FROM rows")
def title_case_(spark, sf_dir):
    return rows_of(spark, sf_dir).select("file", "row_idx", *[title_case(F.col(f)).alias(f) for f in TITLED])


STATES = (
    "SELECT n, CASE n % 9 WHEN 0 THEN 'Active' WHEN 1 THEN ' A ' WHEN 2 THEN 'ON  LEAVE' WHEN 3 THEN 'on_leave' WHEN 4 THEN 'Exited' "
    "WHEN 5 THEN 'unknown ' WHEN 6 THEN NULL WHEN 7 THEN 'Sabbatical' ELSE 'INACTIVE' END AS raw FROM (SELECT o_orderkey AS n FROM orders)"
)


def states(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS n").selectExpr(
        "n", STATES[len("SELECT n, "):STATES.index(" FROM (SELECT")])


@query("normalize_enum", f"SELECT n, raw, coalesce({enum('raw')}, raw) AS value FROM ({STATES})")
def normalize_enum(spark, sf_dir):
    return states(spark, sf_dir).withColumn("value", C.canonical(BY_NAME["employment_status"], F.col("raw"), SCHEMA))


@query("canonical_enum", f"SELECT n, raw, {enum('raw')} AS canonical FROM ({STATES})")
def canonical_enum(spark, sf_dir):
    table = SCHEMA.enum_variants("employment_status", with_canonical=True)
    return states(spark, sf_dir).withColumn("canonical", literal_lookup(table, F.lower(squeeze(F.col("raw")))))


@query("clean_dates", f"WITH {TEXTS} SELECT n, raw, CASE WHEN len({days('raw')}) = 1 THEN {days('raw')}[1] ELSE raw END AS value FROM texts")
def clean_dates(spark, sf_dir):
    return texts(spark, sf_dir).withColumn("value", C.iso_date(BY_NAME["date_of_joining"], F.col("raw"), {}))


@query(
    "ambiguous_dates",
    f"WITH {TEXTS}, v AS (SELECT n, raw, {sq('raw')} AS x FROM texts WHERE len({days('raw')}) > 1), r AS ("
    f"SELECT n, raw, 'iso' AS format, {iso('x')} AS parsed FROM v UNION ALL SELECT n, raw, 'dd/mm', {dmy('x')} FROM v "
    f"UNION ALL SELECT n, raw, 'mm/dd', {mdy('x')} FROM v UNION ALL SELECT n, raw, 'text-month', {spelled('x')} FROM v) "
    "SELECT * FROM r WHERE parsed IS NOT NULL",
)
def ambiguous_dates(spark, sf_dir):
    field = BY_NAME["date_of_joining"]
    return texts(spark, sf_dir).where(C.is_ambiguous(field, F.col("raw"), {})).select(
        "n", "raw", F.explode(readings(F.col("raw"))).alias("r")).select("n", "raw", "r.*")


PHONES = (
    "CASE k % 5 WHEN 0 THEN '+91 (' || CAST(k AS STRING) || ') 55-66' WHEN 1 THEN '00' || CAST(k AS STRING) || '+12' "
    "WHEN 2 THEN 'tel. +' || CAST(k AS STRING) || '+7' WHEN 3 THEN 'n/k' ELSE CAST(k AS STRING) END"
)


@query(
    "normalize_phone",
    f"SELECT k, raw, coalesce(nullif({phone_sql('raw')}, ''), raw) AS value FROM (SELECT k, {PHONES} AS raw FROM (SELECT o_orderkey AS k FROM orders))",
)
def normalize_phone(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k", f"{PHONES} AS raw")
    return rows.withColumn("value", C.normal_phone(F.col("raw")))


def change_sql() -> str:
    """Every single change of the merged records, step by step."""
    parts = []
    for f in FIELDS:
        t = tidy(f)
        parts.append(
            f"SELECT natural_key, '{f}' AS field, {f} AS before, {t} AS after, CASE WHEN {sq(f)} <> {f} AND {t} <> {sq(f)} THEN "
            f"'{C.REASONS["both"]}' WHEN {t} <> {sq(f)} THEN '{C.REASONS["cased"]}' ELSE "
            f"'{C.REASONS["spaced"]}' END AS reason FROM named WHERE {t} <> {f}"
        )
        reason = {"employment_status": C.REASONS["enum"], "phone": C.REASONS["phone"], "salary": C.REASONS["number"]}.get(f)
        reason = C.REASONS["iso"] if f in DATE_FIELDS else C.REASONS["email"] if f in EMAIL_FIELDS else reason
        if reason:
            parts.append(f"SELECT natural_key, '{f}', {t}, {cleaned(f)}, '{reason}' FROM named WHERE {cleaned(f)} <> {t}")
    return " UNION ALL ".join(parts)


@query("change_log", f"WITH RECURSIVE {cleaned_sql()} {change_sql()}")
def change_log(spark, sf_dir):
    return C.change_log(C.clean_records(merged_of(spark, sf_dir), SCHEMA))


@query("clean_record", f"WITH RECURSIVE {cleaned_sql()} SELECT natural_key, {', '.join(FIELDS)} FROM cleaned")
def clean_record(spark, sf_dir):
    return C.clean_records(merged_of(spark, sf_dir), SCHEMA).select("natural_key", *FIELDS)


# ---------------------------------------------------------------- automatic fixes and rules
ODD = {
    "email": (
        "CASE n % 6 WHEN 0 THEN 'c ' || CAST(n AS STRING) || ' @ACME.com' WHEN 1 THEN 'c' || CAST(n AS STRING) || '@acme' "
        "WHEN 2 THEN ' c' || CAST(n AS STRING) || '@acme.com' WHEN 3 THEN 'Ann Lee' WHEN 4 THEN NULL ELSE 'a@b@c.org' END"
    ),
    "date_of_joining": (
        "CASE n % 5 WHEN 0 THEN '2021-3-' || CAST(n % 35 + 1 AS STRING) WHEN 1 THEN '2021-02-' || lpad(CAST(n % 31 AS STRING), 2, '0') "
        "WHEN 2 THEN '05/06/2020' WHEN 3 THEN '  ' ELSE '21-01-01' END"
    ),
    "employment_status": "CASE n % 4 WHEN 0 THEN 'active' WHEN 1 THEN ' on_leave ' WHEN 2 THEN 'Active' ELSE NULL END",
    "salary": (
        "CASE n % 7 WHEN 0 THEN '1,234,' || lpad(CAST(n % 1000 AS STRING), 3, '0') WHEN 1 THEN CAST(n AS STRING) || '.5' WHEN 2 THEN 'nan' "
        "WHEN 3 THEN '1_000' WHEN 4 THEN '-' || CAST(n AS STRING) || 'e3' WHEN 5 THEN 'n/k' ELSE '.' END"
    ),
    "full_name": "CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE 'Ann' END",
}
ODD_SQL = "odd AS (SELECT n, " + ", ".join(f"{e} AS {f}" for f, e in ODD.items()) + " FROM (SELECT o_orderkey AS n FROM orders))"


def odd(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS n").selectExpr("n", *[f"{e} AS {f}" for f, e in ODD.items()])


FIXED = "replace(lower(trim(email)), ' ', '')"


@query("fix_email", f"WITH {ODD_SQL} SELECT n, email, CASE WHEN NOT {is_email('email')} AND {is_email(FIXED)} THEN {FIXED} ELSE email END AS fixed FROM odd")
def fix_email(spark, sf_dir):
    return odd(spark, sf_dir).select("n", "email", C.fixed_email(F.col("email")).alias("fixed"))


@query(
    "fix_number",
    f"WITH {ODD_SQL} SELECT n, salary, CASE WHEN {is_number('salary')} AND contains(salary, ',') THEN replace(trim(salary), ',', '') ELSE salary END AS fixed FROM odd",
)
def fix_number(spark, sf_dir):
    return odd(spark, sf_dir).select("n", "salary", C.fixed_number(F.col("salary")).alias("fixed"))


def rule(name: str, field: str) -> None:
    @query(name, f"WITH {ODD_SQL} SELECT n, {field} AS value, {error(field)} AS error FROM odd")
    def run(spark, sf_dir):
        return odd(spark, sf_dir).select("n", F.col(field).alias("value"), V.broken_rule(BY_NAME[field]).alias("error"))


for rule_name, rule_field in {
    "rule_required": "full_name", "rule_email": "email", "rule_iso_date": "date_of_joining",
    "rule_enum": "employment_status", "rule_number": "salary",
}.items():
    rule(rule_name, rule_field)


@query("validate_records", f"WITH RECURSIVE {cleaned_sql()} {errors_of('cleaned', 'natural_key')}")
def validate_records(spark, sf_dir):
    return V.error_rows(V.with_errors(C.clean_records(merged_of(spark, sf_dir), SCHEMA), SCHEMA))


ROW_CLEAN = ", ".join(f"{cleaned(f)} AS {f}" for f in FIELDS)
WAITING = ", ".join(f"len({days(tidy(f))}) > 1 AS {f}_waits" for f in DATE_FIELDS)


@query(
    "suppress_pending_dates",
    f"WITH {X.rows_sql()}, tidied AS (SELECT file || ':' || row_idx AS natural_key, {ROW_CLEAN}, {WAITING} FROM rows), "
    f"errors AS ({errors_of('tidied', 'natural_key, date_of_joining_waits, date_of_birth_waits')}) "
    "SELECT natural_key, field, error, value FROM errors WHERE NOT ((field = 'date_of_joining' AND coalesce(date_of_joining_waits, false)) "
    "OR (field = 'date_of_birth' AND coalesce(date_of_birth_waits, false)))",
)
def suppress_pending_dates(spark, sf_dir):
    """Each source row as a record of its own, before any date order is known."""
    rows = rows_of(spark, sf_dir).withColumn("natural_key", F.concat_ws(":", "file", "row_idx"))
    checked = V.with_errors(C.clean_records(rows, SCHEMA), SCHEMA)
    return V.error_rows(checked.withColumn("errors", V.without_pending(F.col("errors"), F.col("pending_dates"))))


# ---------------------------------------------------------------- lookup
LOOKUP = (
    f"{cleaned_sql()}, known AS (SELECT DISTINCT email AS key, {tokens('email')} AS b FROM kept WHERE email IS NOT NULL), "
    f"asked AS (SELECT DISTINCT manager_email AS value, {tokens('manager_email')} AS a FROM cleaned WHERE {sq('manager_email')} <> '' AND NOT contains(manager_email, '@')), "
    f"scores AS (SELECT value, key, CAST({per_mille(lcs_bits('a', 'b'), 'len(a) + len(b)')} AS INT) AS score FROM asked, known), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, key) AS rank FROM scores), "
    "matches AS (SELECT * FROM ranked WHERE rank <= 3), tops AS (SELECT value, key, score FROM matches WHERE rank = 1), "
    "resolved AS (SELECT cleaned.*, key, score, value IS NOT NULL AND score >= 900 AS sure, value IS NOT NULL AND score < 900 AS asks "
    "FROM cleaned LEFT JOIN tops ON manager_email = value)"
)


def checked_of(spark, sf_dir):
    return C.clean_records(merged_of(spark, sf_dir), SCHEMA)


@query("known_keys", f"WITH RECURSIVE {kept_sql()} SELECT DISTINCT email AS key FROM kept WHERE email IS NOT NULL")
def known_keys(spark, sf_dir):
    return known_contacts(kept_of(spark, sf_dir), SCHEMA)


@query(
    "unresolved_refs",
    f"WITH RECURSIVE {cleaned_sql()} SELECT natural_key, manager_email AS value FROM cleaned WHERE {sq('manager_email')} <> '' AND NOT contains(manager_email, '@')",
)
def unresolved_refs(spark, sf_dir):
    return checked_of(spark, sf_dir).where(L.is_unresolved("manager_email")).select("natural_key", F.col("manager_email").alias("value"))


def lookup_of(spark, sf_dir):
    kept = stage(kept_of(spark, sf_dir), "kept")
    merged = S.merged_records(kept, SCHEMA).withColumn("natural_key", E.natural_key(SCHEMA))
    records = stage(C.clean_records(merged, SCHEMA), "checked")
    matches = L.top_matches(L.unresolved_values(records, "manager_email"), known_contacts(kept, SCHEMA))
    return records, matches


@query("fuzzy_lookup_topk", f"WITH RECURSIVE {LOOKUP} SELECT value, CAST(rank AS INT) AS rank, key, CAST(score AS DOUBLE) / 1000 AS score FROM matches")
def fuzzy_lookup_topk(spark, sf_dir):
    _, matches = lookup_of(spark, sf_dir)
    return L.option_rows(matches).select("value", "rank", "key", "score")


@query(
    "resolve_lookup",
    f"WITH RECURSIVE {LOOKUP} SELECT natural_key, CASE WHEN sure THEN key ELSE manager_email END AS manager_email, "
    "CASE WHEN sure THEN manager_email END AS lookup_from, asks AS lookup_open FROM resolved",
)
def resolve_lookup(spark, sf_dir):
    records, matches = lookup_of(spark, sf_dir)
    return L.resolve(records, matches, SCHEMA).select("natural_key", "manager_email", "lookup_from", "lookup_open")


# ---------------------------------------------------------------- records
FINAL_FIELDS = ", ".join("CASE WHEN sure THEN key ELSE manager_email END AS manager_email" if f == "manager_email" else f for f in FIELDS)
RECORDS = (
    f"{LOOKUP}, " + conflicts_sql()[len(kept_sql()) + 2:] + ", "
    f"gold AS (SELECT entity_id, natural_key, n_rows, {FINAL_FIELDS}, asks FROM resolved), "
    f"bad AS (SELECT * FROM ({errors_of('gold', 'natural_key')}) WHERE field <> 'manager_email' OR contains(value, '@')), "
    "statuses AS (SELECT gold.*, CASE WHEN asks OR entity_id IN (SELECT entity_id FROM conflicts) OR natural_key IN (SELECT natural_key FROM bad) "
    "THEN 'needs_review' ELSE 'valid' END AS status FROM gold)"
)


@query("record_status", f"WITH RECURSIVE {RECORDS} SELECT natural_key, status FROM statuses")
def record_status(spark, sf_dir):
    return consolidate(rows_of(spark, sf_dir), SCHEMA).records.select("natural_key", "status")


@query("golden_records", f"WITH RECURSIVE {RECORDS} SELECT natural_key, n_rows, {', '.join(FIELDS)}, status FROM statuses")
def golden_records(spark, sf_dir):
    return consolidate(rows_of(spark, sf_dir), SCHEMA).records.select("natural_key", "n_rows", *FIELDS, "status")
