"""Decisions are an append-only table; the newest one per subject counts.

Columns: decision_id, type, key (any match key of the record), file, column, field,
action (approve, correct, reject), value, resolved_by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TargetSchema

SCHEMA = (
    "decision_id bigint, type string, key string, file string, column string, "
    "field string, action string, value string, resolved_by string"
)
MAPPING = ("ambiguous_mapping", "unmapped_column")
RECORD = ("value_conflict", "validation_failure", "manager_unresolved")
ACTIONS = ("approve", "correct", "reject")
DROP = "__drop__"


def taken(decisions: DataFrame) -> DataFrame:
    """Decisions with a known type and action; :func:`refused` has the others."""
    return decisions.where(F.col("type").isin(*MAPPING, *RECORD, "ambiguous_date") & F.col("action").isin(*ACTIONS))


def refused(decisions: DataFrame) -> DataFrame:
    """Decisions that change nothing, with the reason."""
    kind = F.coalesce(F.col("type").isin(*MAPPING, *RECORD, "ambiguous_date"), F.lit(False))
    action = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    return decisions.where(~(kind & action)).withColumn(
        "error", F.when(~kind, "unknown type of question").otherwise("unknown action"))


def latest(decisions: DataFrame, *keys: str) -> DataFrame:
    """Newest decision per key: an aggregate that combines before the shuffle."""
    rest = [c for c in decisions.columns if c not in keys]
    newest = decisions.groupBy(*keys).agg(F.max(F.struct("decision_id", *[c for c in rest if c != "decision_id"])).alias("d"))
    return newest.select(*keys, "d.*")


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def apply_mapping_decisions(mappings: DataFrame, decisions: DataFrame, schema: TargetSchema) -> DataFrame:
    """Settle mappings by hand: reject or drop a column, or name its target field.

    Only a rejection or ``__drop__`` drops a column. A value that is blank or names no field
    changes nothing; see :func:`invalid_targets`.
    """
    own = latest(taken(decisions).where(F.col("type").isin(*MAPPING)).select(
        "decision_id", "file", F.col("column").alias("header"), "action", "value"
    ), "file", "header").withColumnsRenamed({"decision_id": "_id", "action": "_action", "value": "_value"})
    dropped = F.col("_id").isNotNull() & (
        (F.col("_action") == "reject") | F.coalesce(F.col("_value") == DROP, F.lit(False))
    )
    picked = F.col("_id").isNotNull() & ~dropped & F.coalesce(F.col("_value").isin(*schema.names), F.lit(False))
    return mappings.join(own, ["file", "header"], "left").withColumns({
        "target_field": F.when(picked, F.col("_value")).when(~dropped | F.col("_id").isNull(), F.col("target_field")),
        "method": F.when(picked, "manual").otherwise(F.col("method")),
        "confidence": F.when(picked, F.lit(1.0)).otherwise(F.col("confidence")),
        "status": F.when(dropped, "rejected").when(picked, "resolved").otherwise(F.col("status")),
    }).drop("_id", "_action", "_value")


def invalid_targets(decisions: DataFrame, schema: TargetSchema) -> DataFrame:
    """Mapping decisions that name no field of the schema, or nothing at all."""
    value = F.coalesce("value", F.lit(""))
    return decisions.where(
        F.col("type").isin(*MAPPING) & (F.col("action") != "reject") & (value != DROP) & ~value.isin(*schema.names)
    )


def on_closed(decisions: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions on questions that are open, the others with the reason).

    A decision answers the question of its type about its column, its field or its record and field.
    ``queue`` has type, entity_ref and status.
    """
    ref = (
        F.when(F.col("type").isin(*MAPPING), F.concat_ws(":", "file", "column"))
        .when(F.col("type") == "ambiguous_date", F.col("field"))
        .when(F.col("type") == "manager_unresolved", F.col("key"))
        .otherwise(F.concat_ws(":", "key", "field"))
    )
    named = decisions.withColumn("entity_ref", ref)
    open_now = queue.where(F.col("status") == "open").select("type", "entity_ref").distinct()
    kept = named.join(open_now, ["type", "entity_ref"], "left_semi").select(*decisions.columns)
    return kept, named.join(open_now, ["type", "entity_ref"], "left_anti").select(*decisions.columns, F.lit("no open question").alias("error"))


def forced_formats(decisions: DataFrame) -> DataFrame:
    """(field, label) decided for a date field; a rejection leaves the values raw."""
    own = latest(taken(decisions).where(F.col("type") == "ambiguous_date").select("decision_id", "field", "action", "value"), "field")
    return own.select(
        "field",
        F.when((F.col("action") == "reject") | blank(F.col("value")), "raw").otherwise(F.col("value")).alias("label"),
    )


def record_edits(decisions: DataFrame, entity_keys: DataFrame, schema: TargetSchema) -> DataFrame:
    """(entity_id, field, sets, value, rejected): newest record decision per field.

    ``entity_keys`` leads from any key of a record to its entity of the current build.
    """
    own = taken(decisions).where(F.col("type").isin(*RECORD)).select(
        "decision_id", "type", "key",
        F.when(F.col("type") == "manager_unresolved", schema.lookup_field).otherwise(F.col("field")).alias("field"),
        "action", "value",
    )
    # Nobody knows the size of decisions that were just derived: a wrong guess would send them whole to every task.
    placed = latest(own.hint("merge").join(entity_keys, "key").drop("key"), "entity_id", "field")
    lookup = F.col("type") == "manager_unresolved"
    given = ~blank(F.col("value"))
    return placed.select(
        "entity_id",
        "field",
        F.when(lookup, True)
        .when(F.col("type") == "value_conflict", given & (F.col("action") != "reject"))
        .otherwise((F.col("action") != "reject") & F.col("value").isNotNull())
        .alias("sets"),
        F.when(lookup & ~given, F.lit(None).cast("string")).otherwise(F.col("value")).alias("value"),
        ((F.col("type") == "validation_failure") & (F.col("action") == "reject")).alias("rejected"),
    )


def wide_edits(edits: DataFrame, schema: TargetSchema) -> DataFrame:
    """One row per entity: a struct(value) per edited field, and the rejected flag."""
    return edits.groupBy("entity_id").agg(
        *[
            F.max(F.when((F.col("field") == n) & F.col("sets"), F.struct("value"))).alias(f"{n}__edit")
            for n in schema.names
        ],
        F.max("rejected").alias("rejected"),
    )


def replay(records: DataFrame, edits: DataFrame, schema: TargetSchema) -> DataFrame:
    """Put the decided values into the records and note their origin."""
    joined = records.join(wide_edits(edits, schema), "entity_id", "left")
    set_by_hand = F.array_compact(F.array(*[
        F.when(F.col(f"{n}__edit").isNotNull(), F.struct(
            F.lit(n).alias("key"),
            F.struct(F.lit("human").alias("file"), F.col(f"{n}__edit.value").alias("raw")).alias("value"),
        )) for n in schema.names
    ]))
    fresh = F.map_from_entries(set_by_hand)
    kept = F.map_filter(F.col("provenance"), lambda k, v: ~F.map_contains_key(fresh, k))
    out = []
    for c in records.columns:
        if c in schema.names:
            edit = F.col(f"{c}__edit")
            out.append(F.when(edit.isNotNull(), edit["value"]).otherwise(F.col(c)).alias(c))
        elif c == "provenance":
            out.append(F.map_concat(kept, fresh).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(
        *out,
        F.coalesce("rejected", F.lit(False)).alias("rejected"),
        F.col(f"{schema.lookup_field}__edit").isNotNull().alias("lookup_decided")
        if schema.has(schema.lookup_field) else F.lit(False).alias("lookup_decided"),
    )


def affected_entities(decisions: DataFrame, entity_keys: DataFrame) -> DataFrame:
    """Entities whose records a set of decisions can change."""
    return (
        decisions.where(F.col("type").isin(*RECORD)).select("key").distinct()
        .join(entity_keys, "key").select("entity_id").distinct()
    )
