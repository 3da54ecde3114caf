"""Messy exports of one workforce, derived from the customer and orders tables.

Three systems describe the same people: ``hr`` has one row per customer, ``crm`` one
row per order of a customer (so copies of a person pile up), ``payroll`` one row per
customer with a positive balance. The expressions are plain SQL, so the check can
state them for another engine as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.matching import field_columns
from ..schema import TargetSchema, norm_name
from ..session import fresh_path
from ..sources.readers import null_tokens, union_sources, with_lineage

PK = "lpad(CAST(k AS STRING), 9, '0')"
BOSS = "CAST(CAST(floor(k / 10) AS BIGINT) AS STRING)"
TITLE = (
    "CASE k % 5 WHEN 0 THEN 'ops  manager' WHEN 1 THEN 'O''NEIL r&d lead' "
    "WHEN 2 THEN 'qa/test engineer' WHEN 3 THEN '3rd line support' ELSE 'HR partner' END"
)
PLACE = (
    "CASE k % 3 WHEN 0 THEN 'NATION ' WHEN 1 THEN ' nation  ' ELSE 'Nation ' END"
    " || CAST(nationkey AS STRING)"
)


def two(e: str) -> str:
    return f"lpad(CAST({e} AS STRING), 2, '0')"


def year(e: str) -> str:
    return f"lpad(CAST(year({e}) AS STRING), 4, '0')"


LATER = "CASE WHEN k % 13 = 0 THEN day(d) % 28 + 1 ELSE day(d) END"

HR = {
    "Emp ID": f"CASE WHEN k % 29 = 11 THEN 'TBD' ELSE 'E' || {PK} END",
    "Employee Name": "CASE WHEN k % 4 = 0 THEN '  ' || name || ' ' ELSE name END",
    "Work Email": (
        "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 19 = 3 THEN 'C' || CAST(k AS STRING) || ' @acme.com' "
        "WHEN k % 23 = 5 THEN 'c' || CAST(k AS STRING) || '_at_acme.com' "
        "ELSE 'c' || CAST(k AS STRING) || '@acme.com' END"
    ),
    "Dept": "CASE WHEN k % 6 = 1 THEN ' ' || lower(segment) ELSE segment END",
    "Designation": TITLE,
    "DOJ": f"{two('day(d)')} || '-' || {two('month(d)')} || '-' || {year('d')}",
    "DOB": (
        "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '30/02/1985' ELSE "
        f"{two('k * 7 % 28 + 1')} || '/' || {two('k % 12 + 1')} || '/' || CAST(1960 + k % 40 AS STRING) END"
    ),
    "Reporting Manager Email": f"CASE WHEN k % 9 = 4 THEN NULL ELSE 'c' || {BOSS} || '@acme.com' END",
    "Office Location": PLACE,
    "Status": (
        "CASE k % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'active ' WHEN 2 THEN 'ON LEAVE' "
        "WHEN 3 THEN 'Resigned' ELSE 'Contractor' END"
    ),
}
CRM = {
    "id": PK,
    "name": "name",
    "email_address": (
        "CASE WHEN k % 7 = 0 OR k % 13 = 2 THEN NULL ELSE upper('c' || CAST(k AS STRING) || '@acme.com') END"
    ),
    "mobile": f"'+91-' || substr({PK}, 1, 5) || '-' || substr({PK}, 6, 4)",
    "team": "CASE WHEN priority = '1-URGENT' AND k % 11 = 0 THEN 'Sales' ELSE segment END",
    "title": f"CASE WHEN k % 17 = 6 THEN 'Principal' ELSE upper({TITLE}) END",
    "joined_on": f"{two('month(d)')} || '/' || {two('day(d)')} || '/' || {year('d')}",
    "manager": (
        f"CASE WHEN k % 27 = 4 THEN 'c' || {BOSS} || '.acme.com' "
        f"ELSE 'Customer#' || lpad({BOSS}, 9, '0') END"
    ),
    "city": PLACE,
}
PAYROLL = {
    "EmployeeCode": f"'E' || {PK}",
    "FullName": "name",
    "PersonalEmail": "'p' || CAST(k AS STRING) || '@gmail.com'",
    "CTC": (
        "CASE WHEN pay >= 1000 THEN CAST(CAST(floor(pay / 1000) AS BIGINT) AS STRING) || ',' || "
        "lpad(CAST(pay % 1000 AS STRING), 3, '0') ELSE CAST(pay AS STRING) END"
    ),
    "Grade": "'L' || CAST(k % 9 AS STRING)",
    "DateOfJoining": f"{year('d')} || '-' || {two('month(d)')} || '-' || {two(LATER)}",
    "BankName": "'Bank ' || CAST(nationkey AS STRING)",
    "EmploymentType": "CASE WHEN k % 8 = 0 THEN 'Part-time' ELSE 'Full-time' END",
}
EXPORTS = {"hr": HR, "crm": CRM, "payroll": PAYROLL}
FILES = list(EXPORTS)

PEOPLE = (
    "c_custkey AS k, c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment, "
    "CAST(round(c_acctbal * 100) AS BIGINT) AS pay"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three exports with ``row_idx``, headers as their systems write them."""
    people = table(spark, sf_dir, "customer").selectExpr(*PEOPLE.split(", "))
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey AS k", "o_orderdate", "o_orderpriority AS priority"
    )
    first = orders.groupBy("k").agg({"o_orderdate": "min"}).toDF("k", "d")
    dated = people.join(first, "k", "left")
    bases = {
        "hr": dated.selectExpr("*", "k AS row_idx"),
        "crm": orders.select("k", "o_orderkey", "priority").join(dated, "k").selectExpr("*", "o_orderkey AS row_idx"),
        "payroll": dated.where("pay > 0").selectExpr("*", "k AS row_idx"),
    }
    return {
        name: bases[name].selectExpr(*[f"{e} AS `{c}`" for c, e in cols.items()], "row_idx")
        for name, cols in EXPORTS.items()
    }


# Export files already written by this application: (application, data folder, file) to path.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def raw_exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The exports as files: the input of a run is written once per application."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir, FILES[0]) not in _WRITTEN:
        for name, df in derive_exports(spark, sf_dir).items():
            path = fresh_path(spark, f"export-{name}")
            df.repartition(spark.sparkContext.defaultParallelism, "row_idx").write.parquet(path)
            _WRITTEN[app, sf_dir, name] = path
    schema = {n: ", ".join(f"`{c}` string" for c in cols) + ", row_idx bigint" for n, cols in EXPORTS.items()}
    return {n: spark.read.schema(schema[n]).parquet(_WRITTEN[app, sf_dir, n]) for n in FILES}


def declared_pairs(columns: list[str], schema: TargetSchema) -> list[tuple[str, str]]:
    """(column, field) where a header is a declared spelling of a field."""
    owner = schema.alias_owner()
    return [(c, owner[norm_name(c)]) for c in columns if norm_name(c) in owner]


def mapped_rows(spark: SparkSession, sf_dir: str, schema: TargetSchema) -> DataFrame:
    """All rows of the three exports in target fields, with their lineage."""
    parts = []
    for i, (name, df) in enumerate(raw_exports(spark, sf_dir).items()):
        columns = list(EXPORTS[name])
        mapped = null_tokens(df, columns).select(
            "row_idx", *field_columns(declared_pairs(columns, schema), schema, columns)
        )
        parts.append(with_lineage(mapped, name, i))
    return union_sources(parts)


# ---------------------------------------------------------------- the same, for the check
def people_sql() -> str:
    return (
        f"people AS (SELECT {PEOPLE} FROM customer), "
        "firsts AS (SELECT o_custkey AS k, min(o_orderdate) AS d FROM orders GROUP BY o_custkey), "
        "dated AS (SELECT people.*, firsts.d FROM people LEFT JOIN firsts ON people.k = firsts.k), "
        "crm_base AS (SELECT dated.*, o_orderkey, o_orderpriority AS priority FROM orders "
        "JOIN dated ON o_custkey = dated.k)"
    )


def raw_sql() -> str:
    """CTEs hr, crm and payroll."""
    base = {"hr": "dated", "crm": "crm_base", "payroll": "dated WHERE pay > 0"}
    idx = {"hr": "k", "crm": "o_orderkey", "payroll": "k"}
    ctes = [people_sql()]
    for name, cols in EXPORTS.items():
        listed = ", ".join(f'{e} AS "{c}"' for c, e in cols.items())
        ctes.append(f"{name} AS (SELECT {listed}, {idx[name]} AS row_idx FROM {base[name]})")
    return ", ".join(ctes)


# The mapping of the exports, written out.
MAPPED = {
    "hr": {
        "employee_id": "Emp ID", "full_name": "Employee Name", "email": "Work Email", "department": "Dept",
        "job_title": "Designation", "date_of_joining": "DOJ", "date_of_birth": "DOB",
        "manager_email": "Reporting Manager Email", "location": "Office Location", "employment_status": "Status",
    },
    "crm": {
        "employee_id": "id", "full_name": "name", "email": "email_address", "phone": "mobile",
        "department": "team", "job_title": "title", "date_of_joining": "joined_on",
        "manager_email": "manager", "location": "city",
    },
    "payroll": {
        "employee_id": "EmployeeCode", "full_name": "FullName", "salary": "CTC",
        "date_of_joining": "DateOfJoining",
    },
}
FIELDS = [
    "employee_id", "full_name", "email", "phone", "department", "job_title", "date_of_joining",
    "date_of_birth", "manager_email", "location", "employment_status", "salary",
]


def rows_sql() -> str:
    """CTEs up to ``rows``: file, file_ord, row_idx and one column per target field."""
    parts = []
    for i, name in enumerate(FILES):
        cols = ", ".join(
            (f'"{MAPPED[name][f]}"' if f in MAPPED[name] else "CAST(NULL AS VARCHAR)") + f" AS {f}" for f in FIELDS
        )
        parts.append(f"SELECT '{name}' AS file, {i} AS file_ord, row_idx, {cols} FROM {name}")
    return raw_sql() + ", rows AS (" + " UNION ALL ".join(parts) + ")"
