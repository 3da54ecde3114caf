"""Scans, sources, declared schemas and profiles."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import is_number, looks_like_date
from ..operators import matching, profiling
from ..plans import exports as X
from ..schema import employee_schema
from ..session import fresh_path, stage
from ..sources import declared, many, readers, workbook
from . import query
from .sql import TOKENS, is_number as number_sql

SCHEMA = employee_schema()

# Customers with cells that spell "no value" in several ways, as common SQL.
MESSY = {
    "Name ": "CASE WHEN c_custkey % 10 = 3 THEN 'N/A' ELSE ' ' || c_name || ',\"' || c_mktsegment || '\" ' END",
    " Balance": "CASE WHEN c_custkey % 10 IN (3, 4) THEN 'NaN' ELSE CAST(c_nationkey AS STRING) END",
    "Segment": "CASE c_custkey % 5 WHEN 3 THEN 'null' WHEN 4 THEN 'None' ELSE c_mktsegment END",
    "Key": "CASE WHEN c_custkey % 10 = 3 THEN '' ELSE CAST(c_custkey AS STRING) END",
}


def messy(spark, sf_dir):
    """Strings only, with the order column."""
    return X.table(spark, sf_dir, "customer").selectExpr(
        *[f"{e} AS `{c}`" for c, e in MESSY.items()], "c_custkey AS ord"
    )


def messy_sql(then: str) -> str:
    cols = ", ".join(f'{e} AS "{c}"' for c, e in MESSY.items())
    nulled = ", ".join(f'CASE WHEN "{c}" NOT IN ({TOKENS}) THEN "{c}" END AS "{c}"' for c in MESSY)
    return (
        f"WITH messy AS (SELECT {cols}, c_custkey AS ord FROM customer), "
        f"nulled AS (SELECT {nulled}, ord FROM messy) {then}"
    )


PLAIN = '"Name " AS name, " Balance" AS balance, "Segment" AS segment, "Key" AS key'


def plain(df, *extra):
    return df.select(
        F.col("`Name `").alias("name"), F.col("` Balance`").alias("balance"),
        F.col("Segment").alias("segment"), F.col("Key").alias("key"), *extra,
    )


KEPT = "WHERE NOT (name IS NULL AND balance IS NULL AND segment IS NULL AND key IS NULL)"


@query(
    "read_csv_export",
    messy_sql(
        f"SELECT name, balance, segment, key, row_number() OVER (ORDER BY ord) - 1 AS row_idx "
        f"FROM (SELECT {PLAIN}, ord FROM nulled) {KEPT}"
    ),
)
def read_csv_export(spark, sf_dir):
    path = fresh_path(spark, "export-csv")
    out = messy(spark, sf_dir).repartitionByRange("ord").sortWithinPartitions("ord").drop("ord")
    out.write.option("header", True).option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = readers.read_csv_export(spark, path)
    return read.select(
        F.col("Name").alias("name"), F.col("Balance").alias("balance"), F.col("Segment").alias("segment"),
        F.col("Key").alias("key"), "row_idx",
    )


def ragged(spark, sf_dir):
    """An export of two columns in which some rows have a cell too many, and others a comma in quotes."""
    path = fresh_path(spark, "ragged-csv")
    lines = X.table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 7 IN (0, 1) THEN CAST(c_custkey AS STRING) || ',' || c_name || "
        "CASE WHEN c_custkey % 7 = 0 THEN ',' || c_mktsegment ELSE '' END "
        "ELSE CAST(c_custkey AS STRING) || ',\"' || c_name || ', ' || c_mktsegment || '\"' END AS line",
    )
    # Every part of an export starts with its header.
    lines.repartition(4).mapInPandas(_with_header, "line string").write.text(path)
    return path


def _with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"line": ["key,name"]})
    yield from batches


RAGGED = (
    "SELECT CAST(c_custkey AS STRING) AS key, CASE WHEN c_custkey % 7 = 1 THEN c_name ELSE c_name || ', ' || c_mktsegment END AS name, "
    "NULL AS line FROM customer WHERE c_custkey % 7 <> 0 UNION ALL "
    "SELECT CAST(c_custkey AS STRING), c_name, CAST(c_custkey AS STRING) || ',' || c_name || ',' || c_mktsegment FROM customer WHERE c_custkey % 7 = 0"
)


@query("csv_ragged_rows", RAGGED)
def csv_ragged_rows(spark, sf_dir):
    """Rows with too many cells come out with their whole text, the others as rows."""
    path = ragged(spark, sf_dir)
    rows = readers.read_csv_export(spark, path, "apart").select("key", "name")
    errors = readers.csv_errors(spark, path).select(
        F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"), "line")
    return rows.withColumn("line", F.lit(None).cast("string")).unionByName(errors)


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _book(rows: list[list[str | None]]) -> bytes:
    """A workbook whose first sheet is in its second part; texts are shared, the last column has a date format."""
    shared: dict[str, int] = {}

    def cell(ref: str, j: int, i: int, text: str | None) -> str:
        if text is None:
            return ""
        if i and j == len(rows[0]) - 1:
            return f'<c r="{ref}" s="1"><v>{text}</v></c>'
        return f'<c r="{ref}" t="s"><v>{shared.setdefault(text, len(shared))}</v></c>'

    body = "".join(
        f'<row r="{i + 1}">' + "".join(cell("ABCDE"[j] + str(i + 1), j, i, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows)
    )
    items = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in shared)
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{REL}"><sheets><sheet name="a" sheetId="2" r:id="x2"/><sheet name="b" sheetId="1" r:id="x1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd\\-mmm\\-yyyy"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {MAIN}>{items}</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>",
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return data.getvalue()


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Workbooks of up to 1,000 rows each, to have something to read."""
    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.iloc[start:start + 1000]
            rows = [["Key", " Name ", "Segment", "Name", "Since"], *part[["key", "name", "segment", "key", "serial"]].values.tolist()]
            yield pd.DataFrame([(f"book-{part['key'].iloc[0]}.xlsx", _book(rows))], columns=["path", "content"])


@query(
    "read_excel_export",
    "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment, "
    "CAST(c_custkey AS VARCHAR) AS again, CAST(DATE '2000-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS VARCHAR) AS since FROM customer",
)
def read_excel_export(spark, sf_dir):
    """The first sheet in the workbook's own order, with shared texts, dates and a header that comes twice."""
    rows = X.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "N/A").otherwise(F.col("c_mktsegment")).alias("segment"),
        (F.col("c_custkey") % 9000 + 36526).cast("string").alias("serial"),
    )
    books = stage(rows.mapInPandas(_pack, "path string, content binary"), "workbooks")
    wide = workbook.wide_rows(books, ["Key", "Name", "Segment", "Name.1", "Since"])
    return wide.select("Key", "Name", "Segment", F.col("`Name.1`").alias("again"), "Since").toDF("key", "name", "segment", "again", "since")


@query("null_tokens", messy_sql(f"SELECT {PLAIN}, ord FROM nulled"))
def null_tokens(spark, sf_dir):
    return plain(readers.null_tokens(messy(spark, sf_dir), list(MESSY)), "ord")


@query("drop_empty_rows", messy_sql(f"SELECT * FROM (SELECT {PLAIN}, ord FROM nulled) {KEPT}"))
def drop_empty_rows(spark, sf_dir):
    return plain(readers.drop_empty_rows(readers.null_tokens(messy(spark, sf_dir), list(MESSY)), list(MESSY)), "ord")


@query(
    "normalize_headers",
    messy_sql('SELECT "Name " AS "Name", " Balance" AS "Balance", "Segment", "Key", ord FROM messy'),
)
def normalize_headers(spark, sf_dir):
    return readers.normalize_headers(messy(spark, sf_dir))


@query(
    "row_lineage",
    "SELECT 'orders' AS file, 7 AS file_ord, o_orderkey AS source_key, "
    "row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx FROM orders",
)
def row_lineage(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_orderkey").alias("source_key"))
    dense = readers.dense_index(rows, [F.col("o_orderdate"), F.col("source_key")])
    return readers.with_lineage(dense.select("source_key", "row_idx"), "orders", 7)


@query("union_sources", f"WITH {X.rows_sql()} SELECT * FROM rows")
def union_sources(spark, sf_dir):
    return X.mapped_rows(spark, sf_dir, SCHEMA)


CATALOG = " UNION ALL ".join(
    f"SELECT '{n}' AS file, {i} AS file_ord, (SELECT count(*) FROM {n}) AS row_count, "
    f"{len(c)} AS n_columns, '{'|'.join(c)}' AS columns"
    for i, (n, c) in enumerate(X.EXPORTS.items())
)


@query("source_catalog", f"WITH {X.raw_sql()} {CATALOG}")
def source_catalog(spark, sf_dir):
    got = readers.source_catalog(list(X.raw_exports(spark, sf_dir).items()))
    return got.select(
        "file", "file_ord", "row_count", F.size("columns").alias("n_columns"), F.array_join("columns", "|").alias("columns")
    )


# One export per nation, with one of three headers.
NATION_HEADERS = ["Emp ID,Name,Email", "Name,Emp ID,Department,Email", "Email,Locker,Emp ID"]
NATION_LINES = (
    "CASE c_nationkey % 3 WHEN 0 THEN 'E' || c_custkey || ',\"' || c_name || CASE WHEN c_custkey % 50 = 1 THEN chr(10) ELSE ' ' END || c_mktsegment || '\",NA' "
    "WHEN 1 THEN c_name || ',E' || c_custkey || ',' || c_mktsegment || ',c' || c_custkey || '@x.org' "
    "ELSE 'c' || c_custkey || '@x.org,' || c_acctbal || ',E' || c_custkey END"
)
NATION_ROWS = (
    "SELECT 'nation_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_idx, "
    "'E' || c_custkey AS employee_id, CASE c_nationkey % 3 WHEN 0 THEN c_name || CASE WHEN c_custkey % 50 = 1 THEN chr(10) ELSE ' ' END || c_mktsegment WHEN 1 THEN c_name END AS full_name, "
    "CASE WHEN c_nationkey % 3 > 0 THEN 'c' || c_custkey || '@x.org' END AS email, CASE WHEN c_nationkey % 3 = 1 THEN c_mktsegment END AS department FROM customer"
)


def nation_exports(spark, sf_dir):
    """A folder with one CSV file per nation, in a folder of its name."""
    path = fresh_path(spark, "nations")
    lines = X.table(spark, sf_dir, "customer").selectExpr("c_nationkey", "c_custkey", f"{NATION_LINES} AS line")
    heads = F.element_at(F.array(*[F.lit(h) for h in NATION_HEADERS]), F.col("c_nationkey") % 3 + 1)
    whole = lines.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("rows")).select(
        F.concat(F.lit("nation_"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("export"),
        F.concat_ws("\n", heads, F.col("rows.line")).alias("value"))
    whole.write.option("lineSep", "\n").partitionBy("export").text(path)
    return path


@query("many_files", f"{NATION_ROWS}")
def many_files(spark, sf_dir):
    """25 files with three different headers, one with line breaks in cells, in one scan and one plan."""
    exports = many.read_exports(spark, nation_exports(spark, sf_dir), "nation_[0-9]+")
    mappings = stage(matching.match_columns(readers.column_catalog(exports.catalog), SCHEMA), "mappings")
    return many.map_exports(exports, mappings, SCHEMA).select("file", "row_idx", "employee_id", "full_name", "email", "department")


@query(
    "list_files",
    "SELECT 'nation_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS file, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS INT) AS file_ord, "
    "count(*) AS row_count, CASE c_nationkey % 3 " + " ".join(f"WHEN {i} THEN '{h.replace(',', '|')}'" for i, h in enumerate(NATION_HEADERS))
    + " END AS columns FROM customer GROUP BY c_nationkey",
)
def list_files(spark, sf_dir):
    """All files of an export folder with their rows and columns, whatever their number, in one plan."""
    exports = many.read_exports(spark, nation_exports(spark, sf_dir), "nation_[0-9]+")
    return exports.catalog.withColumn("columns", F.array_join("columns", "|"))


# One declared schema per supplier, in every accepted shape, as common SQL.
SCHEMA_JSON = (
    "CASE s_suppkey % 6 "
    "WHEN 0 THEN '{\"entity\":\"party ' || s_name || '\",\"primary_key\":\"code_' || CAST(s_suppkey AS STRING) || '\","
    "\"match_keys\":[\"mail\",\"code_' || CAST(s_suppkey AS STRING) || '\"],\"fields\":{\"code_' || CAST(s_suppkey AS STRING) || "
    "'\":{\"type\":\"string\",\"required\":true,\"aliases\":[\"code\",\"Ref No\"]},\"mail\":{\"aliases\":[\"e mail\"]},"
    "\"state\":{\"type\":\"enum\",\"allowed\":[\"on\",\"off\"],\"aliases\":[\"code\"]}},"
    "\"enum_normalization\":{\"state\":{\"on\":[\"yes\",\"y\"],\"off\":[\"no\"]}},\"display_field\":\"mail\","
    "\"target_system_rules\":{\"required_fields\":[\"state\"],\"blocked_email_domains\":[\"x' || CAST(s_suppkey AS STRING) || '.org\"]}}' "
    "WHEN 1 THEN '{\"fields\":{\"name_' || CAST(s_nationkey AS STRING) || '\":{\"type\":\"string\"},\"birth_date\":{},\"work-email\":{}}}' "
    "WHEN 2 THEN '{\"fields\":{\"title\":\"string\",\"grade\":\"\",\"price_' || CAST(s_suppkey AS STRING) || '\":\"number\",\"unit price\":\"\"}}' "
    "WHEN 3 THEN '{\"fields\":[\"supplier_id\",{\"name\":\"contact mail\",\"required\":true},{\"field\":\"created_at\"},\"n_' || CAST(s_suppkey AS STRING) || '\"]}' "
    "WHEN 4 THEN '[\"name\",\"email\",\"age\",\"Valid_' || CAST(s_suppkey AS STRING) || '\"]' "
    "ELSE '{\"entity\":\"empty\",\"fields\":{}}' END"
)


def declared_schemas(spark, sf_dir):
    return X.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS schema_id", f"{SCHEMA_JSON} AS schema_json")


HINT_SQL = (
    "CASE WHEN list_has_any(w, ['email', 'e-mail', 'mail']) THEN 'email' "
    "WHEN list_has_any(w, ['date', 'dob', 'doj', 'birth', 'joining', 'created', 'updated']) THEN 'date' "
    "WHEN list_has_any(w, ['salary', 'ctc', 'compensation', 'amount', 'price', 'cost', 'age']) THEN 'number' "
    "WHEN list_has_any(w, ['status', 'state', 'type', 'category', 'level', 'grade']) THEN 'enum' ELSE 'string' END"
)


def hint_sql(name: str) -> str:
    words = f"string_split(translate(lower({name}), '_-', '  '), ' ')"
    return HINT_SQL.replace("list_has_any(w,", f"list_has_any({words},")


RULES = (
    f"declared AS (SELECT s_suppkey AS schema_id, {SCHEMA_JSON} AS schema_json FROM supplier), "
    "body AS (SELECT schema_id, CASE WHEN schema_json[1] = '[' THEN schema_json::JSON "
    "ELSE json_extract(schema_json, '$.fields') END AS fields FROM declared), "
    "items AS (SELECT schema_id, i AS pos, CASE WHEN json_type(v) = 'OBJECT' THEN "
    "coalesce(json_extract_string(v, '$.name'), json_extract_string(v, '$.field')) ELSE v->>'$' END AS field, "
    "CASE WHEN json_type(v) = 'OBJECT' THEN v END AS spec, NULL::VARCHAR AS named "
    "FROM (SELECT schema_id, unnest(range(0, json_array_length(fields)::BIGINT)) AS i, "
    "json_extract(fields, '$[' || unnest(range(0, json_array_length(fields)::BIGINT)) || ']') AS v FROM body "
    "WHERE json_type(fields) = 'ARRAY') "
    "UNION ALL SELECT schema_id, i, field, CASE WHEN json_type(v) = 'OBJECT' THEN v END, "
    "CASE WHEN json_type(v) = 'VARCHAR' AND (v->>'$') <> '' THEN v->>'$' END FROM ("
    "SELECT schema_id, i, field, json_extract(fields, '$.\"' || field || '\"') AS v FROM ("
    "SELECT schema_id, fields, unnest(range(0, len(json_keys(fields))::BIGINT)) AS i, unnest(json_keys(fields)) AS field "
    "FROM body WHERE json_type(fields) = 'OBJECT'))), "
    f"rules AS (SELECT schema_id, pos AS ord, field, coalesce(spec->>'$.type', named, {hint_sql('field')}) AS type, "
    "coalesce((spec->>'$.required')::BOOLEAN, false) AS required, "
    "coalesce(json_extract(spec, '$.aliases')::VARCHAR[], []) AS aliases, "
    "coalesce(json_extract(spec, '$.allowed')::VARCHAR[], []) AS allowed FROM items)"
)


def rules_of(spark, sf_dir):
    return declared.field_rules(declared_schemas(spark, sf_dir))


@query(
    "schema_rules",
    f"WITH {RULES} SELECT schema_id, CAST(ord AS INT) AS ord, 'field' AS kind, field, type AS value, required, "
    "array_to_string(aliases, ',') AS extra FROM rules "
    "UNION ALL SELECT schema_id, CAST(i - 1 AS INT), 'allowed', field, allowed[i], false, '' "
    "FROM (SELECT *, unnest(range(1, len(allowed) + 1)) AS i FROM rules) "
    "UNION ALL SELECT schema_id, 0, 'variant', 'state', v, false, c FROM declared, "
    "(VALUES ('yes', 'on'), ('y', 'on'), ('no', 'off')) t(v, c) WHERE json_extract(schema_json, '$.enum_normalization') IS NOT NULL "
    "UNION ALL SELECT schema_id, 0, 'required_fields', NULL, json_extract_string(schema_json, '$.target_system_rules.required_fields[0]'), "
    "false, '' FROM declared WHERE json_extract(schema_json, '$.target_system_rules') IS NOT NULL "
    "UNION ALL SELECT schema_id, 0, 'blocked_email_domains', NULL, "
    "json_extract_string(schema_json, '$.target_system_rules.blocked_email_domains[0]'), "
    "false, '' FROM declared WHERE json_extract(schema_json, '$.target_system_rules') IS NOT NULL "
    "UNION ALL SELECT schema_id, 0, 'error', NULL, 'a target schema needs at least one field', false, '' FROM declared "
    "WHERE schema_id NOT IN (SELECT schema_id FROM rules)",
)
def schema_rules(spark, sf_dir):
    given = declared_schemas(spark, sf_dir)
    rules = rules_of(spark, sf_dir)
    none, no = F.lit(None).cast("string"), F.lit(False)
    fields = rules.select(
        "schema_id", "ord", F.lit("field").alias("kind"), "field", F.col("type").alias("value"), "required",
        F.array_join("aliases", ",").alias("extra"),
    )
    allowed = rules.select("schema_id", "field", F.posexplode("allowed").alias("ord", "value")).select(
        "schema_id", "ord", F.lit("allowed").alias("kind"), "field", "value", no.alias("required"), F.lit("").alias("extra"))
    variants = declared.variant_rows(given).select(
        "schema_id", F.lit(0).alias("ord"), F.lit("variant").alias("kind"), "field", F.col("variant").alias("value"),
        no.alias("required"), F.col("canonical").alias("extra"))
    target = declared.target_rule_rows(given).select(
        "schema_id", "ord", "kind", none.alias("field"), "value", no.alias("required"), F.lit("").alias("extra"))
    errors = declared.empty_schemas(given, rules).select(
        "schema_id", F.lit(0).alias("ord"), F.lit("error").alias("kind"), none.alias("field"),
        F.col("error").alias("value"), no.alias("required"), F.lit("").alias("extra"))
    return readers.union_sources([fields, allowed, variants, target, errors])


# Column names of a catalog: words of part names and types.
NAMES = "p_name || CASE p_size % 6 WHEN 0 THEN '_date' WHEN 1 THEN ' E-Mail' WHEN 2 THEN '-cost' WHEN 3 THEN ' Level' WHEN 4 THEN '_mail id' ELSE '' END"


@query("infer_field_type", f"SELECT p_partkey, name, {hint_sql('name')} AS type FROM (SELECT p_partkey, {NAMES} AS name FROM part)")
def infer_field_type(spark, sf_dir):
    return X.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{NAMES} AS name").withColumn(
        "type", declared.hinted_type(F.col("name")))


KEYS = (
    "heads AS (SELECT schema_id, coalesce(nullif(json_extract_string(any_value(schema_json), '$.primary_key'), ''), "
    "first(field ORDER BY ord) FILTER (WHERE contains(lower(field), 'id')), first(field ORDER BY ord)) AS primary_key, "
    "coalesce(list(field ORDER BY ord) FILTER (WHERE type = 'email'), []) AS emails, "
    "json_extract(any_value(schema_json), '$.match_keys')::VARCHAR[] AS given, count(*) AS field_count, "
    "coalesce(json_extract_string(any_value(schema_json), '$.entity'), 'record') AS entity, "
    "json_extract_string(any_value(schema_json), '$.display_field') AS display_field "
    "FROM rules JOIN declared USING (schema_id) GROUP BY schema_id), "
    "keyed AS (SELECT *, array_to_string(coalesce(given, CASE WHEN list_contains(emails, primary_key) THEN emails "
    "ELSE list_append(emails, primary_key) END), ',') AS match_keys FROM heads)"
)


@query("derive_keys", f"WITH {RULES}, {KEYS} SELECT schema_id, primary_key, match_keys FROM keyed")
def derive_keys(spark, sf_dir):
    return declared.derived_keys(declared_schemas(spark, sf_dir), rules_of(spark, sf_dir)).withColumn(
        "match_keys", F.array_join("match_keys", ","))


@query(
    "schema_preview",
    f"WITH {RULES}, {KEYS} SELECT schema_id, entity, primary_key, match_keys, field_count, display_field, "
    "CAST(ord AS INT) AS ord, field, type, required, array_to_string(aliases, ',') AS aliases FROM rules JOIN keyed USING (schema_id)",
)
def schema_preview(spark, sf_dir):
    return declared.schema_preview(declared_schemas(spark, sf_dir), rules_of(spark, sf_dir)).select(
        "schema_id", "entity", "primary_key", F.array_join("match_keys", ",").alias("match_keys"), "field_count",
        "display_field", "ord", "field", "type", "required", F.array_join("aliases", ",").alias("aliases"))


@query(
    "surface_terms",
    f"WITH {RULES}, spelled AS (SELECT schema_id, ord, field, 0 AS pos, field AS surface FROM rules UNION ALL "
    "SELECT schema_id, ord, field, i, aliases[i] FROM (SELECT *, unnest(range(1, len(aliases) + 1)) AS i FROM rules)) "
    "SELECT schema_id, surface, last(field ORDER BY ord, pos) AS field FROM spelled GROUP BY schema_id, surface",
)
def surface_terms(spark, sf_dir):
    return declared.surface_rows(rules_of(spark, sf_dir)).select("schema_id", "surface", "field")


# ---------------------------------------------------------------- profiling
PROFILED = [f for f in X.FIELDS]


def cells_of(spark, sf_dir):
    return profiling.long_cells(X.mapped_rows(spark, sf_dir, SCHEMA), PROFILED, ["file", "row_idx"])


LONG = " UNION ALL ".join(
    f"SELECT file, row_idx, '{f}' AS \"column\", {f} AS value FROM rows WHERE {f} IS NOT NULL" for f in X.FIELDS
)
SAMPLED = (
    f"WITH {X.rows_sql()}, cells AS ({LONG}), ranked AS (SELECT *, row_number() OVER (PARTITION BY file, \"column\" "
    "ORDER BY row_idx) AS pos FROM cells), samples AS (SELECT * FROM ranked WHERE pos <= 5)"
)
DATE_LIKE = (
    "(len(trim(value)) BETWEEN 6 AND 12 AND len(regexp_replace(value, '[^/.\\-]', '', 'g')) >= 2 "
    "AND len(regexp_replace(value, '[^0-9]', '', 'g')) >= 4)"
)
TYPE_OF = (
    "CASE WHEN count(*) FILTER (WHERE trim(value) <> '') = 0 THEN 'empty' "
    "WHEN avg(contains(value, '@')::INT) FILTER (WHERE trim(value) <> '') >= 0.6 THEN 'email' "
    f"WHEN avg({DATE_LIKE}::INT) FILTER (WHERE trim(value) <> '') >= 0.6 THEN 'date' "
    f"WHEN avg({number_sql('value')}::INT) FILTER (WHERE trim(value) <> '') >= 0.8 THEN 'number' ELSE 'string' END"
)


@query("column_samples", SAMPLED + ' SELECT file, "column", CAST(pos AS INT) AS pos, value FROM samples')
def column_samples(spark, sf_dir):
    return profiling.column_samples(cells_of(spark, sf_dir)).select("file", "column", "pos", "value")


@query(
    "column_non_empty",
    f"WITH {X.rows_sql()}, cells AS ({LONG}) SELECT f.file, c.\"column\", count(cells.value) AS non_empty FROM "
    "(SELECT DISTINCT file FROM rows) f CROSS JOIN (SELECT unnest(["
    + ", ".join(f"'{f}'" for f in X.FIELDS)
    + ']) AS "column") c LEFT JOIN cells ON cells.file = f.file AND cells."column" = c."column" GROUP BY ALL',
)
def column_non_empty(spark, sf_dir):
    return profiling.non_empty_counts(X.mapped_rows(spark, sf_dir, SCHEMA), PROFILED)


@query("classify_column", SAMPLED + f' SELECT file, "column", {TYPE_OF} AS inferred_type FROM samples GROUP BY ALL')
def classify_column(spark, sf_dir):
    return profiling.classify(profiling.column_samples(cells_of(spark, sf_dir)))


@query(
    "profile_full",
    f'WITH {X.rows_sql()}, cells AS ({LONG}) SELECT file, "column", {TYPE_OF} AS inferred_type, count(*) AS non_empty '
    "FROM cells GROUP BY ALL",
)
def profile_full(spark, sf_dir):
    return cells_of(spark, sf_dir).groupBy("file", "column").agg(
        profiling.dominant_type(F.col("value")).alias("inferred_type"), F.count("*").alias("non_empty"))


@query(
    "file_profile",
    SAMPLED + f', typed AS (SELECT file, "column", {TYPE_OF} AS inferred_type, '
    "string_agg(value, '|' ORDER BY pos) AS samples FROM samples GROUP BY ALL), "
    'counted AS (SELECT file, "column", count(*) AS non_empty FROM cells GROUP BY ALL) '
    'SELECT f.file, c."column", coalesce(inferred_type, \'empty\') AS inferred_type, coalesce(non_empty, 0) AS non_empty, '
    "coalesce(samples, '') AS samples FROM (SELECT DISTINCT file FROM rows) f CROSS JOIN (SELECT unnest(["
    + ", ".join(f"'{f}'" for f in X.FIELDS)
    + ']) AS "column") c LEFT JOIN typed ON typed.file = f.file AND typed."column" = c."column" '
    'LEFT JOIN counted ON counted.file = f.file AND counted."column" = c."column"',
)
def file_profile(spark, sf_dir):
    return profiling.file_profile(X.mapped_rows(spark, sf_dir, SCHEMA), PROFILED).withColumn(
        "samples", F.array_join("samples", "|"))


# Values of many kinds: numbers, dates, addresses and words.
VALUES = (
    "CASE l_linenumber % 7 WHEN 0 THEN CAST(l_partkey AS STRING) || ',' || lpad(CAST(l_suppkey AS STRING), 3, '0') "
    "WHEN 1 THEN ' ' || CAST(l_partkey AS STRING) || '.5e1 ' WHEN 2 THEN CAST(day(l_shipdate) AS STRING) || '/' || "
    "CAST(month(l_shipdate) AS STRING) || '/' || CAST(year(l_shipdate) AS STRING) "
    "WHEN 3 THEN CAST(year(l_shipdate) AS STRING) || '-' || CAST(month(l_shipdate) AS STRING) || '-' || CAST(day(l_shipdate) AS STRING) "
    "WHEN 4 THEN l_returnflag || CAST(l_suppkey AS STRING) || '@acme.com' WHEN 5 THEN '-' || CAST(l_suppkey AS STRING) || '.' "
    "ELSE l_linestatus || '-1.2.3' END"
)


def odd_values(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{VALUES} AS value")


@query(
    "looks_like_date",
    f"SELECT l_orderkey, l_linenumber, value, {DATE_LIKE} AS hit FROM (SELECT l_orderkey, l_linenumber, {VALUES} AS value FROM lineitem)",
)
def looks_like_date_(spark, sf_dir):
    return odd_values(spark, sf_dir).withColumn("hit", looks_like_date(F.col("value")))


@query(
    "looks_like_number",
    f"SELECT l_orderkey, l_linenumber, value, {number_sql('value')} AS hit FROM "
    f"(SELECT l_orderkey, l_linenumber, {VALUES} AS value FROM lineitem)",
)
def looks_like_number_(spark, sf_dir):
    return odd_values(spark, sf_dir).withColumn("hit", is_number(F.col("value")))
