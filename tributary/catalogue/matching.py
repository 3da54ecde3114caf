"""Schema matching over a catalog of column headers derived from the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import as_score, token_sort_score
from ..functions.text import norm_header
from ..operators import matching as M
from ..operators import profiling
from ..plans import exports as X
from ..plans.consolidate import map_sources
from ..schema import employee_schema
from ..session import fresh_path, stage
from ..sources import readers
from . import query
from .sql import lcs, lcs_bits, per_mille, sq, tokens

SCHEMA = employee_schema()

# Headers of one feed per customer, as common SQL.
HEADERS = [
    "CASE k % 4 WHEN 0 THEN 'Emp ID' WHEN 1 THEN '  EMPLOYEE   CODE ' WHEN 2 THEN 'Staff Id' ELSE 'employee-id' END",
    "CASE k % 6 WHEN 0 THEN 'Work  Email' WHEN 1 THEN 'EmailAddress' WHEN 2 THEN 'Mail of ' || segment "
    "WHEN 3 THEN 'PersonalEmail' WHEN 4 THEN 'oficial email' ELSE 'emaill' END",
    "lower(segment) || ' departments'",
    "'Joining Date ' || CAST(nationkey AS STRING)",
    "CASE k % 7 WHEN 0 THEN 'Grade' WHEN 1 THEN 'BankName' WHEN 2 THEN 'EmploymentType' WHEN 3 THEN 'CTC' "
    "WHEN 4 THEN 'annual salry' WHEN 5 THEN 'locaton' ELSE 'birth dates' END",
    "name",
]
PEOPLE = f"people AS (SELECT {X.PEOPLE} FROM customer)"
CATALOG = PEOPLE + ", catalog AS (" + " UNION ALL ".join(
    f"SELECT 'feed_' || CAST(k AS STRING) AS file, {i} AS col_ord, {e} AS header FROM people" for i, e in enumerate(HEADERS)
) + ")"


def catalog(spark, sf_dir):
    people = X.table(spark, sf_dir, "customer").selectExpr(*X.PEOPLE.split(", "))
    cells = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.expr(e).alias("header")) for i, e in enumerate(HEADERS)])
    return people.select(F.concat(F.lit("feed_"), F.col("k").cast("string")).alias("file"), F.explode(cells).alias("c")).select(
        "file", "c.col_ord", "c.header")


SURFACES = ", ".join(f"({i}, '{s}', '{f}')" for i, (s, f) in enumerate(SCHEMA.surfaces()))
NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(SCHEMA.names))
ALIASES = ", ".join(f"('{a}', '{f}')" for a, f in SCHEMA.alias_owner().items())
NORM = "lower(" + sq("header") + ")"

SCORED = (
    f"{CATALOG}, surfaces(ord, surface, field) AS (VALUES {SURFACES}), aliases(alias, field) AS (VALUES {ALIASES}), "
    f"heads AS (SELECT header, aliases.field AS alias_field FROM (SELECT DISTINCT header FROM catalog) LEFT JOIN aliases ON {NORM} = alias), "
    f"pairs AS (SELECT header, ord, surface, field, {tokens('header')} AS a, {tokens('surface')} AS b FROM heads, surfaces WHERE alias_field IS NULL), "
    f"scored AS (SELECT header, ord, surface, field, CAST({per_mille(lcs_bits('a', 'b'), 'len(a) + len(b)')} AS INT) AS score FROM pairs), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, ord) AS rank FROM scored), "
    "top8 AS (SELECT * FROM ranked WHERE rank <= 8), "
    "folded AS (SELECT header, field, max(score) AS score, min(rank) AS first_rank FROM top8 GROUP BY header, field), "
    "cands AS (SELECT header, field, score, row_number() OVER (PARTITION BY header ORDER BY score DESC, first_rank) AS place FROM folded), "
    "best AS (SELECT * FROM cands WHERE place <= 4), "
    "tops AS (SELECT header, max(score) FILTER (WHERE place = 1) AS s1, max(score) FILTER (WHERE place = 2) AS s2, "
    "max(field) FILTER (WHERE place = 1) AS f1 FROM best GROUP BY header), "
    "decided AS (SELECT heads.header, alias_field, s1, s2, "
    "CASE WHEN alias_field IS NOT NULL THEN 'auto_apply' WHEN s1 IS NULL THEN 'unmapped_column' "
    "WHEN s2 IS NOT NULL AND s1 - s2 <= 80 THEN 'ambiguous_mapping' WHEN s1 >= 700 THEN 'auto_apply' ELSE 'unmapped_column' END AS decision, "
    "CASE WHEN alias_field IS NOT NULL THEN alias_field WHEN (s2 IS NULL OR s1 - s2 > 80) AND s1 >= 700 THEN f1 END AS target_field, "
    "CASE WHEN alias_field IS NOT NULL THEN 'alias' ELSE 'fuzzy' END AS method, "
    "CASE WHEN alias_field IS NOT NULL THEN 1000 ELSE coalesce(s1, 0) END AS confidence, "
    "coalesce(alias_field IS NULL AND NOT (s2 IS NOT NULL AND s1 - s2 <= 80) AND s1 >= 700 AND s1 < 900, false) AS low_confidence "
    "FROM heads LEFT JOIN tops ON heads.header = tops.header)"
)
ADJUDICATED = (
    f"{SCORED}, own(ord, field) AS (VALUES {NAMES}), "
    "tied AS (SELECT best.header, best.field FROM best JOIN tops ON best.header = tops.header "
    "JOIN decided ON decided.header = best.header WHERE decision = 'ambiguous_mapping' AND tops.s1 - best.score <= 80), "
    "choices AS (SELECT header, field FROM tied UNION ALL SELECT header, own.field FROM decided, own WHERE decision = 'unmapped_column'), "
    f"asked AS (SELECT header, choices.field, ord, {tokens('header')} AS a, {tokens('choices.field')} AS b FROM choices JOIN own ON own.field = choices.field), "
    f"answers AS (SELECT header, field, ord, CAST({per_mille(lcs_bits('a', 'b'), 'len(a) + len(b)')} AS INT) AS score FROM asked), "
    "suggested AS (SELECT header, first(field ORDER BY score DESC, ord) AS suggested, max(score) AS suggested_score FROM answers GROUP BY header)"
)
FINAL = (
    f"{ADJUDICATED}, final AS (SELECT decided.header, decision, decided.confidence AS match_confidence, "
    "CASE WHEN decision = 'auto_apply' THEN target_field WHEN suggested_score >= 900 THEN suggested END AS target_field, "
    "CASE WHEN decision = 'auto_apply' THEN method WHEN suggested_score >= 900 OR decision = 'unmapped_column' THEN 'llm' ELSE 'fuzzy' END AS method, "
    "CASE WHEN decision = 'auto_apply' THEN confidence WHEN suggested_score >= 900 OR decision = 'unmapped_column' "
    "THEN coalesce(suggested_score, 0) ELSE confidence END AS confidence, "
    "CASE WHEN decision = 'auto_apply' OR suggested_score >= 900 THEN 'auto_applied' ELSE 'escalated' END AS status "
    "FROM decided LEFT JOIN suggested ON decided.header = suggested.header)"
)


# The headers of the three exports as a catalog of their own.
EXPORT_CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {j}, '{c}')" for n, cols in X.EXPORTS.items() for j, c in enumerate(cols)
) + ") AS c(file, col_ord, header))"
EXPORT_FINAL = FINAL.replace(CATALOG, EXPORT_CATALOG)


@query("norm_header", f"WITH {CATALOG} SELECT file, col_ord, header, {NORM} AS norm FROM catalog")
def norm_header_(spark, sf_dir):
    return catalog(spark, sf_dir).withColumn("norm", norm_header(F.col("header")))


@query(
    "alias_match",
    f"WITH {CATALOG}, aliases(alias, field) AS (VALUES {ALIASES}) SELECT file, col_ord, header, aliases.field AS target_field, "
    f"CAST(1.0 AS DOUBLE) AS confidence FROM catalog JOIN aliases ON {NORM} = alias",
)
def alias_match(spark, sf_dir):
    hit = catalog(spark, sf_dir).withColumn("target_field", M.alias_field(F.col("header"), SCHEMA))
    return hit.where(F.col("target_field").isNotNull()).withColumn("confidence", F.lit(1.0))


PAIRS = "p_name AS left_text, p_brand || ' ' || p_name || ' ' || p_type AS right_text"


@query(
    "token_sort_ratio",
    f"WITH texts AS (SELECT p_partkey, {PAIRS} FROM part), t AS (SELECT *, {tokens('left_text')} AS a, {tokens('right_text')} AS b FROM texts) "
    f"SELECT p_partkey, left_text, right_text, CAST({per_mille(lcs('a', 'b'), 'len(a) + len(b)')} AS DOUBLE) / 1000 AS score FROM t",
)
def token_sort_ratio(spark, sf_dir):
    # Few bytes and much work per row: spread over all cores.
    parts = X.table(spark, sf_dir, "part").repartition(2 * spark.sparkContext.defaultParallelism)
    return parts.selectExpr("p_partkey", *PAIRS.split(", ")).withColumn(
        "score", as_score(token_sort_score(F.col("left_text"), F.col("right_text"))))


def scored(spark, sf_dir):
    return M.score_headers(catalog(spark, sf_dir), SCHEMA)


@query("fuzzy_candidates", f"WITH {SCORED} SELECT header, CAST(rank AS INT) AS rank, surface, field, CAST(score AS DOUBLE) / 1000 AS score FROM top8")
def fuzzy_candidates(spark, sf_dir):
    return scored(spark, sf_dir).select("header", F.posexplode("ranked").alias("pos", "c")).select(
        "header", (F.col("pos") + 1).alias("rank"), "c.surface", "c.field", as_score(-F.col("c.loss")).alias("score"))


@query("fold_best_per_field", f"WITH {SCORED} SELECT header, CAST(place AS INT) AS place, field, CAST(score AS DOUBLE) / 1000 AS score FROM best")
def fold_best_per_field(spark, sf_dir):
    return scored(spark, sf_dir).select("header", F.posexplode("candidates").alias("pos", "c")).select(
        "header", (F.col("pos") + 1).alias("place"), "c.field", as_score(F.col("c.score")).alias("score"))


@query(
    "decide_mapping",
    f"WITH {SCORED} SELECT file, col_ord, catalog.header, decision, target_field, method, CAST(confidence AS DOUBLE) / 1000 AS confidence, "
    "low_confidence FROM catalog JOIN decided ON catalog.header = decided.header",
)
def decide_mapping(spark, sf_dir):
    feed = catalog(spark, sf_dir)
    return feed.join(M.decide(M.score_headers(feed, SCHEMA)), "header").select(
        "file", "col_ord", "header", "decision", "target_field", "method", as_score(F.col("confidence")).alias("confidence"),
        "low_confidence")


@query("tied_fields", f"WITH {ADJUDICATED} SELECT header, field FROM tied")
def tied_fields(spark, sf_dir):
    return M.decide(scored(spark, sf_dir)).where(F.col("decision") == "ambiguous_mapping").select(
        "header", F.explode(M.tied_fields(F.col("candidates"))).alias("field"))


@query("adjudicate", f"WITH {ADJUDICATED} SELECT header, suggested, CAST(suggested_score AS DOUBLE) / 1000 AS score FROM suggested")
def adjudicate(spark, sf_dir):
    open_headers = M.options_for_review(M.decide(scored(spark, sf_dir)), SCHEMA)
    return M.closest_name(SCHEMA)(open_headers).select("header", "suggested", as_score(F.col("suggested_score")).alias("score"))


@query(
    "accept_adjudication",
    f"WITH {FINAL} SELECT file, col_ord, catalog.header, target_field, method, CAST(confidence AS DOUBLE) / 1000 AS confidence, status "
    "FROM catalog JOIN final ON catalog.header = final.header",
)
def accept_adjudication(spark, sf_dir):
    return M.match_columns(catalog(spark, sf_dir), SCHEMA).select(
        "file", "col_ord", "header", "target_field", "method", "confidence", "status")


@query(
    "list_mappings",
    f"WITH {FINAL} SELECT file, col_ord, catalog.header, decision, target_field, method, CAST(confidence AS DOUBLE) / 1000 AS confidence, status, "
    "(SELECT coalesce(string_agg(field || ':' || score, ',' ORDER BY place), '') FROM best WHERE best.header = catalog.header) AS candidates "
    "FROM catalog JOIN final ON catalog.header = final.header WHERE file = 'feed_7'",
)
def list_mappings(spark, sf_dir):
    """The mapping rows of one file, out of a table in folders by a hash of the file: one folder is opened."""
    path = fresh_path(spark, "mappings")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(16)).cast("int")
    every = M.match_columns(catalog(spark, sf_dir), SCHEMA).withColumn("bucket", bucket(F.col("file")))
    every.repartition("bucket").write.partitionBy("bucket").parquet(path)
    own = spark.read.parquet(path).where((F.col("bucket") == bucket(F.lit("feed_7"))) & (F.col("file") == "feed_7"))
    listed = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["field"], c["score"])), ",")
    return own.select(
        "file", "col_ord", "header", "decision", "target_field", "method", "confidence", "status", F.coalesce(listed, F.lit("")).alias("candidates"))


def mapped(spark, sf_dir):
    sources = list(X.raw_exports(spark, sf_dir).items())
    columns = spark.createDataFrame(
        [(n, i, j, c) for i, (n, _) in enumerate(sources) for j, c in enumerate(X.EXPORTS[n])],
        "file string, file_ord int, col_ord int, header string",
    )
    return sources, stage(M.match_columns(columns, SCHEMA, samples=profiling.open_samples(sources)), "mappings")


@query("apply_mapping", f"WITH {X.rows_sql()} SELECT * FROM rows")
def apply_mapping(spark, sf_dir):
    sources, mappings = mapped(spark, sf_dir)
    return map_sources(sources, mappings, SCHEMA)


CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS file, '{c}' AS header, row_idx, \"{c}\" AS value FROM {n}" for n, cols in X.EXPORTS.items() for c in cols
) + ")"
REPORT = (
    f"WITH {X.raw_sql()}, {CELLS}, waits AS (SELECT * FROM (WITH {EXPORT_FINAL} SELECT file, catalog.header, decision, match_confidence FROM catalog "
    "JOIN final ON catalog.header = final.header WHERE status = 'escalated')), ranked AS (SELECT *, row_number() OVER (PARTITION BY file, header ORDER BY row_idx) AS pos "
    "FROM cells SEMI JOIN waits USING (file, header) WHERE value IS NOT NULL), report AS (SELECT file, header, decision AS type, CAST(match_confidence AS DOUBLE) / 1000 AS confidence, "
    "coalesce(string_agg(value, '|' ORDER BY pos) FILTER (WHERE pos <= 5), '') AS samples FROM waits LEFT JOIN ranked USING (file, header) GROUP BY ALL)"
)


@query("unmapped_report", f"{REPORT} SELECT * FROM report")
def unmapped_report(spark, sf_dir):
    return M.unmapped_report(mapped(spark, sf_dir)[1]).withColumn("samples", F.array_join("samples", "|"))
