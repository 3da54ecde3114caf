"""The exception queue: what the rules leave to a person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import as_score
from .profiling import bottom_values, listed

# Types that close by themselves when their cause is gone.
RECORD_TYPES = ("value_conflict", "validation_failure", "ambiguous_date", "manager_unresolved")


def question(
    type_: Column, ref: Column, record: Column, field: Column, context: dict[str, Column], confidence: Column
) -> list[Column]:
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    return [
        type_.alias("type"),
        ref.alias("entity_ref"),
        record.cast("string").alias("record"),
        field.cast("string").alias("field"),
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("context"),
        confidence.cast("double").alias("confidence"),
    ]



def mapping_questions(mappings: DataFrame) -> DataFrame:
    return mappings.where(F.col("status") == "escalated").select(
        *question(
            F.col("decision"), F.concat_ws(":", "file", "header"), F.lit(None), F.lit(None),
            {"source_column": F.col("header"), "file": F.col("file"), "samples": F.array_join("samples", "|")},
            as_score(F.col("match_confidence")),
        )
    )


def conflict_questions(conflicts: DataFrame) -> DataFrame:
    """One question per record and field; the rival values are in the options table."""
    per_field = conflicts.groupBy("natural_key", "field", "kept_file", "kept_value").agg(
        F.count("*").alias("rivals")
    )
    return per_field.select(
        *question(
            F.lit("value_conflict"), F.concat_ws(":", "natural_key", "field"), F.col("natural_key"), F.col("field"),
            {"record": F.col("natural_key"), "field": F.col("field"), "kept": F.col("kept_value"),
             "kept_file": F.col("kept_file"), "rivals": F.col("rivals")},
            F.lit(0.0),
        )
    )


def validation_questions(errors: DataFrame, lookup_field: str) -> DataFrame:
    """Broken rules; a reference without an at sign belongs to the lookup instead."""
    own = errors.where(
        (F.col("field") != lookup_field) | F.coalesce(F.col("value").contains("@"), F.lit(False))
    )
    return own.select(
        *question(
            F.lit("validation_failure"), F.concat_ws(":", "natural_key", "field"), F.col("natural_key"), F.col("field"),
            {"record": F.col("natural_key"), "field": F.col("field"), "value": F.col("value"), "error": F.col("error")},
            F.lit(0.0),
        )
    )


def lookup_questions(records: DataFrame, lookup_field: str) -> DataFrame:
    return records.where("lookup_open").select(
        *question(
            F.lit("manager_unresolved"), F.col("natural_key"), F.col("natural_key"), F.lit(lookup_field),
            {"record": F.col("natural_key"), "manager_name": F.col(lookup_field)}, F.lit(0.0),
        )
    )


def date_samples(pending: DataFrame) -> DataFrame:
    """(field, pos, raw): a few distinct raw samples per field, however many values wait."""
    return bottom_values(pending, ["field"], "raw")


def date_options(pending: DataFrame) -> DataFrame:
    """Distinct (field, format, parsed) over all samples."""
    return (
        pending.select("field", "raw", "options").distinct()
        .select("field", F.explode("options").alias("o")).select("field", "o.format", "o.parsed").distinct()
    )


def date_rollup(pending: DataFrame) -> DataFrame:
    """One row per field: how many distinct values wait, some of them, and the formats on offer."""
    counts = pending.select("field", "raw").distinct().groupBy("field").agg(F.count("*").alias("waiting"))
    samples = counts.join(listed(date_samples(pending), ["field"], "raw"), "field").withColumn("samples", F.array_join("samples", "|"))
    options = date_options(pending).groupBy("field").agg(
        F.count("*").alias("options"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats")
    )
    return samples.join(options, "field", "left")


def date_questions(pending: DataFrame) -> DataFrame:
    """One question per field, however many records wait for it."""
    return date_rollup(pending).select(
        *question(
            F.lit("ambiguous_date"), F.col("field"), F.lit(None), F.col("field"),
            {"field": F.col("field"), "waiting": F.col("waiting"), "samples": F.col("samples"), "formats": F.col("formats")},
            F.lit(0.0),
        )
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dedupe_open(
    raised: DataFrame, queue: DataFrame, order: str, keys: tuple[str, ...] = ("type", "entity_ref")
) -> DataFrame:
    """New questions only: the first one per subject, none that is open already."""
    rest = [c for c in raised.columns if c not in keys]
    one = raised.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
    open_now = queue.where(F.col("status") == "open").select(*keys)
    return one.join(open_now, list(keys), "left_anti")


def auto_close(queue: DataFrame, raised: DataFrame, keys: tuple[str, ...] = ("type", "entity_ref")) -> DataFrame:
    """Open record questions that were not raised again are closed by the agent."""
    again = raised.select(*keys).distinct().withColumn("_again", F.lit(True))
    stale = (
        (F.col("status") == "open") & F.col("type").isin(*RECORD_TYPES) & F.col("_again").isNull()
    )
    return queue.join(again, list(keys), "left").withColumns(
        {
            "status": F.when(stale, "resolved").otherwise(F.col("status")),
            "resolved_by": F.when(stale, "agent").otherwise(F.col("resolved_by")),
        }
    ).drop("_again")


QUEUE = ("run_id", "type", "entity_ref")


def next_queue(queue: DataFrame, raised: DataFrame, keys: tuple[str, ...] = QUEUE, runs: DataFrame | None = None) -> DataFrame:
    """The stored queue after a build of ``runs``, or of the runs in ``raised``.

    ``queue`` has ``keys``, status, resolved_by and opened. Questions that are open stay as they are, record
    questions the build did not raise are closed, others open, anew where they were answered. Each side is
    one row per question and the join is on it, so a run with many questions spreads.
    """
    again = raised.select(*keys).distinct().withColumn("_again", F.lit(True))
    built = (raised if runs is None else runs).select("run_id").distinct().withColumn("_built", F.lit(True))
    both = queue.join(again, list(keys), "full").join(built, "run_id", "left")
    is_open = F.col("status") == "open"
    stale = is_open & F.col("_again").isNull() & F.col("_built").isNotNull() & F.col("type").isin(*RECORD_TYPES)
    opens = F.col("_again").isNotNull() & ~F.coalesce(is_open, F.lit(False))
    return both.select(
        *keys,
        F.when(opens, "open").when(stale, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(stale, "agent").when(~opens, F.col("resolved_by")).alias("resolved_by"),
        (F.coalesce("opened", F.lit(0)) + opens.cast("bigint")).alias("opened"),
    )


def closed_by_agent(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = QUEUE) -> DataFrame:
    """Questions that a build closed."""
    was = before.where(F.col("status") == "open").select(*keys)
    return after.where((F.col("status") == "resolved") & (F.col("resolved_by") == "agent")).join(was, list(keys), "left_semi")


def answered(queue: DataFrame, answers: DataFrame, keys: tuple[str, ...] = QUEUE) -> tuple[DataFrame, DataFrame]:
    """(queue with the answers to open questions, answers refused because there is no open question).

    ``answers`` has ``keys``, status (resolved or rejected) and resolved_by; the newest ``seq`` counts.
    """
    last = answers.groupBy(*keys).agg(F.max(F.struct("seq", "status", "resolved_by")).alias("_a"))
    taken = (F.col("status") == "open") & F.col("_a").isNotNull()
    after = queue.join(last, list(keys), "left").withColumns({
        "status": F.when(taken, F.col("_a.status")).otherwise(F.col("status")),
        "resolved_by": F.when(taken, F.col("_a.resolved_by")).otherwise(F.col("resolved_by")),
    }).drop("_a")
    open_now = queue.where(F.col("status") == "open").select(*keys)
    return after, answers.join(open_now, list(keys), "left_anti").withColumn("error", F.lit("no open question"))


def gate_status(queue: DataFrame, by: str = "run_id") -> DataFrame:
    is_open = F.count_if(F.col("status") == "open")
    return queue.groupBy(by).agg(
        is_open.alias("open_questions"),
        F.when(is_open > 0, "awaiting_review").otherwise("ready_to_push").alias("status"),
    )


def recheck(records: DataFrame, queue: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Status after decisions: open questions and errors of the same run count by equal record key."""
    doubts = queue.where((F.col("status") == "open") & F.col("record").isNotNull()).select(
        "run_id", F.col("record").alias("natural_key")
    )
    if errors is not None:
        doubts = doubts.unionByName(errors.select("run_id", "natural_key"))
    marked = doubts.distinct().withColumn("_doubt", F.lit(True))
    return records.join(marked, ["run_id", "natural_key"], "left").withColumn(
        "status",
        F.when(F.col("status") == "invalid", "invalid")
        .when(F.col("_doubt").isNotNull(), "needs_review")
        .otherwise("valid"),
    ).drop("_doubt")
