"""A whole run: from mapped rows and decisions to records, questions and audit rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import cleaning, dates, decisions as dec, entities, lookup, matching, questions as q
from ..operators import profiling, survivorship, trail, validation
from ..schema import TargetSchema
from ..session import stage
from ..sources import many, readers

ORIGIN = ["entity_id", "natural_key", "n_rows", "origin_file"]


@dataclass
class Build:
    """Stored tables of one build. Everything else is derived from them."""

    schema: TargetSchema
    linked: DataFrame
    kept: DataFrame
    records: DataFrame
    conflicts: DataFrame
    matches: DataFrame
    mappings: DataFrame | None = None
    forced: dict[str, str] = field(default_factory=dict)
    # Every decision so far, and how to make the whole build again with others.
    decisions: DataFrame | None = None
    remake: Callable[[DataFrame], Build] | None = None

    @property
    def changes(self) -> DataFrame:
        return cleaning.change_log(self.records)

    @property
    def errors(self) -> DataFrame:
        return validation.error_rows(self.records)

    @property
    def pending_dates(self) -> DataFrame:
        """Raw samples that wait for a decision on a date format."""
        own = self.records.select(F.explode("pending_dates").alias("p")).select("p.*")
        return own.unionByName(
            survivorship.date_questions(self.conflicts.where("date_question")).select("field", "raw", "options")
        )

    @property
    def questions(self) -> DataFrame:
        parts = [
            q.conflict_questions(self.conflicts.where(~F.col("date_question"))),
            q.lookup_questions(self.records, self.schema.lookup_field),
            q.validation_questions(self.errors, self.schema.lookup_field),
            q.date_questions(self.pending_dates.where(~F.col("field").isin(list(self.forced)))),
        ]
        if self.mappings is not None:
            parts.insert(0, q.mapping_questions(self.mappings))
        return q.union_all(parts)

    @property
    def options(self) -> DataFrame:
        """Answers on offer, one row each, in order (rank, then value)."""
        rivals = self.conflicts.where(~F.col("date_question"))
        ref = F.concat_ws(":", "natural_key", "field").alias("entity_ref")
        kind = F.lit("value_conflict").alias("type")
        none = F.lit(None).cast("double").alias("score")
        kept = rivals.select(kind, ref, F.lit(0).alias("rank"), F.col("kept_value").alias("value"),
                             F.col("kept_file").alias("source"), none).distinct()
        other = rivals.select(kind, ref, (F.col("file_ord") + 1).alias("rank"), "value",
                              F.col("file").alias("source"), none)
        open_lookup = self.records.where("lookup_open").select(
            "natural_key", F.col(self.schema.lookup_field).alias("value"))
        keys = lookup.option_rows(self.matches).join(open_lookup, "value").select(
            F.lit("manager_unresolved").alias("type"), F.col("natural_key").alias("entity_ref"), "rank",
            F.col("key").alias("value"), F.lit("lookup").alias("source"), "score")
        formats = q.date_options(self.pending_dates).select(
            F.lit("ambiguous_date").alias("type"), F.col("field").alias("entity_ref"), F.lit(0).alias("rank"),
            F.col("format").alias("value"), F.col("parsed").alias("source"), none).distinct()
        parts = [kept, other, keys, formats]
        if self.mappings is not None:
            parts.append(
                self.mappings.where(F.col("status") == "escalated")
                .select("decision", "file", "header", F.posexplode("candidates").alias("rank", "c"))
                .select(F.col("decision").alias("type"), F.concat_ws(":", "file", "header").alias("entity_ref"), "rank",
                        F.col("c.field").alias("value"), F.lit("schema").alias("source"),
                        (F.col("c.score") / 1000).alias("score"))
            )
        return q.union_all(parts)

    def audit(self, run_id: int) -> DataFrame:
        """Rows to append to the audit table."""
        ref = F.col("natural_key")
        f = self.schema.lookup_field
        parts = [
            trail.rows(self.changes, run_id, "cleaned_value", "record", ref, F.col("reason"),
                       trail.one(F.col("field"), F.col("before")), trail.one(F.col("field"), F.col("after"))),
            trail.rows(self.records.where(F.col("lookup_from").isNotNull()), run_id, "resolved_manager_lookup", "record", ref,
                       F.lit("best match is above the threshold"), trail.one(F.lit(f), F.col("lookup_from")),
                       trail.one(F.lit(f), F.col(f)) if self.schema.has(f) else None),
            trail.rows(self.questions, run_id, "escalated", "escalation", F.concat_ws(":", "type", "entity_ref"),
                       F.concat(F.lit("needs a decision: "), F.col("type")), None, F.col("context")),
        ]
        if self.mappings is not None:
            auto = self.mappings.where(F.col("status") == "auto_applied")
            target = F.create_map(F.lit("target"), F.col("target_field"), F.lit("confidence"), F.col("confidence").cast("string"))
            parts.append(trail.rows(auto, run_id, "mapped_column", "column", F.concat_ws(":", "file", "header"), F.col("rationale"), None, target))
        return q.union_all(parts)

    def activity(self, run_id: int) -> DataFrame:
        """What the stages of this build did, one row a stage, in order."""
        counts = [
            ("reconciling", self.linked.agg(F.count("*").alias("a"), F.approx_count_distinct("entity_id").alias("b")), "%d rows in about %d entities"),
            ("cleaning", self.changes.agg(F.count("*").alias("a"), F.count(F.when(F.col("field").isNull(), 1)).alias("b")), "%d values cleaned"),
            ("validating", self.records.agg(F.count_if(F.col("status") == "valid").alias("a"), F.count_if(F.col("status") != "valid").alias("b")), "%d records valid, %d not"),
        ]
        if self.mappings is not None:
            done = self.mappings.agg(F.count_if(F.col("status") != "escalated").alias("a"), F.count_if(F.col("status") == "escalated").alias("b"))
            counts.insert(0, ("mapping", done, "%d columns settled, %d wait for a decision"))
        return q.union_all([
            trail.rows(df, run_id, f"activity:{stage_}", "run", F.lit(str(run_id)),
                       F.format_string(text, *[F.col(c) for c in ("a", "b")[: text.count("%d")]]))
            for stage_, df, text in counts
        ])

    def settle(self, run_id: int, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the stored queue after this build, the gate of every run in it)."""
        one = F.lit(run_id).cast("bigint").alias("run_id")
        raised = self.questions.select(one, "type", "entity_ref")
        runs = self.records.sparkSession.range(1).select(one)
        after = stage(q.next_queue(queue, raised, runs=runs), "queue")
        return after, q.gate_status(after)


def map_sources(
    sources: list[tuple[str, DataFrame]], mappings: DataFrame, schema: TargetSchema
) -> DataFrame:
    """Rows of all sources in target fields.

    The mapping table has one row per declared source and column, so the driver may
    read it: it is as small as the headers of the run.
    """
    settled = mappings.where(
        F.col("status").isin("auto_applied", "resolved") & F.col("target_field").isNotNull()
    ).select("file", "col_ord", "header", "target_field").collect()
    by_file: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(settled, key=lambda r: r["col_ord"]):
        by_file.setdefault(r["file"], []).append((r["header"], r["target_field"]))
    parts = []
    for i, (name, df) in enumerate(sources):
        pairs = by_file.get(name, [])
        parts.append(readers.with_lineage(
            df.select("row_idx", *matching.field_columns(pairs, schema, df.columns)), name, i))
    return readers.union_sources(parts)


def build_records(
    kept: DataFrame,
    conflicts: DataFrame,
    schema: TargetSchema,
    forced: dict[str, str],
    edits: DataFrame | None,
    known: DataFrame,
    settings: Settings = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """(records, lookup matches) of the entities in ``kept``: clean, fix, replay, check, look up."""
    merged = survivorship.merged_records(kept, schema).withColumn("natural_key", entities.natural_key(schema))
    df = cleaning.clean_records(merged, schema, forced)
    if edits is not None:
        df = cleaning.renormalize_enums(dec.replay(df, edits, schema), schema)
    else:
        df = df.withColumns({"rejected": F.lit(False), "lookup_decided": F.lit(False)})
    df = validation.with_errors(df, schema).withColumn(
        "errors", validation.without_pending(F.col("errors"), F.col("pending_dates"))
    )
    doubted = conflicts.select("entity_id").distinct().withColumn("_doubt", F.lit(True))
    df = df.join(doubted, "entity_id", "left")
    f = schema.lookup_field
    if schema.has(f):
        df = stage(df, "checked")
        matches = stage(
            lookup.top_matches(
                lookup.unresolved_values(df.where(~F.col("lookup_decided")), f), known,
                settings.top_lookup,
            ),
            "matches",
        )
        df = lookup.resolve(df, matches, schema, settings, skip=F.col("lookup_decided"))
        origin = F.struct(F.lit("agent").alias("file"), F.col("lookup_from").alias("raw"))
        without = F.map_filter("provenance", lambda k, v: k != f)
        df = df.withColumn(
            "provenance",
            F.when(F.col("lookup_from").isNotNull(), F.map_concat(without, F.create_map(F.lit(f), origin)))
            .otherwise(F.col("provenance")),
        )
        # A reference found by the lookup is an address now; an open one has its own question.
        df = df.withColumn(
            "errors",
            F.filter("errors", lambda e: (e["field"] != f) | (F.col("lookup_from").isNull() & e["value"].contains("@"))),
        )
    else:
        matches = df.sparkSession.createDataFrame([], "value string, key string, score int, rank int")
        df = df.withColumns({"lookup_from": F.lit(None).cast("string"), "lookup_open": F.lit(False)})
    status = (
        F.when(F.col("rejected"), "invalid")
        .when(
            F.col("_doubt").isNotNull() | F.col("lookup_open")
            | (F.size("errors") > 0) | (F.size("pending_dates") > 0),
            "needs_review",
        )
        .otherwise("valid")
    )
    return stage(df.withColumn("status", status).drop("_doubt"), "records"), matches


def open_conflicts(
    linked: DataFrame, kept: DataFrame, schema: TargetSchema, forced: dict[str, str],
    edits: DataFrame | None,
) -> DataFrame:
    """Distinct contradictions that no decision has settled, with the record's key."""
    found = survivorship.distinct_disagreements(
        survivorship.disagreements(survivorship.distinct_rows(linked, schema), kept, schema, forced))
    if edits is not None:
        found = found.join(edits.select("entity_id", "field"), ["entity_id", "field"], "left_anti")
    keys = survivorship.merged_records(kept, schema).select("entity_id", entities.natural_key(schema).alias("natural_key"))
    # Days that still differ under a decided format are a plain contradiction.
    asks = survivorship.is_date_question() & ~F.col("field").isin(list(forced))
    return stage(found.join(keys, "entity_id").withColumn("date_question", asks), "conflicts")


def consolidate(
    rows: DataFrame,
    schema: TargetSchema,
    decisions: DataFrame | None = None,
    mappings: DataFrame | None = None,
    settings: Settings = DEFAULT,
) -> Build:
    """Link, merge, clean, check. A deterministic function of rows and decisions."""
    labels = stage(dates.inferred_orders(rows, schema.of_type("date")), "orders") if schema.of_type("date") else None
    dated = dates.rewrite_dates(rows, labels, schema) if labels is not None else rows
    linked = stage(entities.link_rows(dated, schema), "linked")
    kept = stage(survivorship.keep_cells(linked, schema), "kept")
    forced, edits = {}, None
    if decisions is not None:
        # One row per date field of the schema.
        forced = forced_labels(decisions, schema)
        keys = entities.entity_keys(linked, schema, decisions)
        edits = stage(dec.record_edits(decisions, keys, schema), "edits")
    conflicts = open_conflicts(linked, kept, schema, forced, edits)
    known = known_contacts(kept, schema)
    records, matches = build_records(kept, conflicts, schema, forced, edits, known, settings)
    return Build(
        schema, linked, kept, records, conflicts, matches, mappings, forced, decisions,
        lambda given: consolidate(rows, schema, given, mappings, settings),
    )


def known_contacts(kept: DataFrame, schema: TargetSchema) -> DataFrame:
    """Distinct merged contact values, before cleaning."""
    f = schema.contact_field
    if not schema.has(f):
        return kept.sparkSession.createDataFrame([], "key string")
    return kept.select(F.col(f"{f}__kept.raw").alias("key")).where(F.col("key").isNotNull()).distinct()


def forced_labels(decisions: DataFrame, schema: TargetSchema) -> dict[str, str]:
    """The date format decided for each date field of the schema, at most one row each."""
    own = dec.forced_formats(decisions).where(F.col("field").isin(schema.of_type("date")))
    return {r["field"]: r["label"] for r in own.collect()}


def rebuild_affected(build: Build, decisions: DataFrame, settings: Settings = DEFAULT) -> Build:
    """Apply further decisions to a build, beside those it was made with.

    The newest decision on a subject counts, so ``decision_id`` has to rise. Decisions on
    records make only the records they name again; one on a mapping or a date format
    changes rows everywhere and makes the whole build again.
    """
    schema = build.schema
    every = decisions if build.decisions is None else build.decisions.unionByName(decisions)
    if not decisions.where(F.col("type").isin(*dec.MAPPING, "ambiguous_date")).isEmpty():
        if build.remake is None:
            raise ValueError("this build does not know its sources; run it again with all decisions")
        return build.remake(every)
    keys = entities.entity_keys(build.linked, schema, decisions)
    touched = stage(dec.affected_entities(decisions, keys), "touched")
    linked = stage(build.linked.join(touched, "entity_id", "left_semi"), "linked")
    kept = build.kept.join(touched, "entity_id", "left_semi")
    # Earlier decisions on the same records may name them by another key.
    edits = stage(dec.record_edits(every, entities.entity_keys(linked, schema), schema), "edits")
    conflicts = open_conflicts(linked, kept, schema, build.forced, edits)
    records, matches = build_records(
        kept, conflicts, schema, build.forced, edits, known_contacts(build.kept, schema), settings
    )
    rest = lambda df: df.join(touched, "entity_id", "left_anti")
    return Build(
        schema, build.linked, build.kept,
        stage(rest(build.records).unionByName(records), "records"),
        stage(rest(build.conflicts).unionByName(conflicts), "conflicts"),
        stage(build.matches.unionByName(matches).distinct(), "matches"),
        build.mappings, build.forced, every, build.remake,
    )


def run(
    spark: SparkSession,
    sources: list[tuple[str, DataFrame]],
    schema: TargetSchema,
    decisions: DataFrame | None = None,
    settings: Settings = DEFAULT,
    adjudicate: matching.Adjudicator | None = None,
) -> Build:
    """A run from raw exports: match the columns, then consolidate the rows."""
    catalog = readers.column_catalog(readers.source_catalog(sources))
    mappings = matching.match_columns(catalog, schema, settings, adjudicate, profiling.open_samples(sources, settings.sample_size))
    if decisions is not None:
        mappings = dec.apply_mapping_decisions(mappings, decisions, schema)
    mappings = stage(mappings, "mappings")
    build = consolidate(map_sources(sources, mappings, schema), schema, decisions, mappings, settings)
    build.remake = lambda given: run(spark, sources, schema, given, settings, adjudicate)
    return build


def run_files(
    spark: SparkSession,
    path: str,
    schema: TargetSchema,
    decisions: DataFrame | None = None,
    settings: Settings = DEFAULT,
    adjudicate: matching.Adjudicator | None = None,
) -> Build:
    """A run over all CSV exports under a path, however many: one scan, one plan."""
    exports = many.read_exports(spark, path)
    columns = readers.column_catalog(exports.catalog)
    mappings = matching.match_columns(columns, schema, settings, adjudicate, many.open_samples(exports, columns, settings.sample_size))
    if decisions is not None:
        mappings = dec.apply_mapping_decisions(mappings, decisions, schema)
    mappings = stage(mappings, "mappings")
    build = consolidate(stage(many.map_exports(exports, mappings, schema), "rows"), schema, decisions, mappings, settings)
    build.remake = lambda given: run_files(spark, path, schema, given, settings, adjudicate)
    return build
