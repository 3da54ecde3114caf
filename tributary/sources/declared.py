"""Declared schemas as data: a table of JSON texts becomes rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TYPE_HINTS

BODY = "type string, required boolean, aliases array<string>, allowed array<string>"


def hinted_type(name: Column) -> Column:
    """Type guessed from the words of a field name."""
    words = F.split(F.translate(F.lower(name), "_-", "  "), r"\s+")
    out = None
    for kind, hints in TYPE_HINTS.items():
        hit = F.arrays_overlap(words, F.array(*[F.lit(h) for h in hints]))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("string")


def field_rules(declared: DataFrame, key: str = "schema_id", text: str = "schema_json") -> DataFrame:
    """One row per declared field: position, name, type, required, aliases, allowed.

    Accepts a full spec, a name-to-type map, a list of names or objects, or a bare
    list. Later declarations of a name replace earlier ones, at the first position.
    """
    root = F.trim(F.col(text))
    fields = F.when(root.startswith("["), root).otherwise(F.get_json_object(root, "$.fields"))
    is_list = F.trim(fields).startswith("[")
    listed = F.transform(
        F.from_json(fields, "array<string>"),
        lambda x: F.struct(
            F.when(
                F.trim(x).startswith("{"),
                F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.field")),
            ).otherwise(x).alias("key"),
            F.when(F.trim(x).startswith("{"), x).alias("value"),
        ),
    )
    mapped = F.transform(
        F.map_entries(F.from_json(fields, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )
    entries = declared.select(
        key, F.posexplode(F.when(is_list, listed).otherwise(mapped)).alias("pos", "e")
    ).select(key, "pos", F.col("e.key").alias("field"), F.col("e.value").alias("body"))
    body = F.trim(F.col("body"))
    spec = F.when(body.startswith("{"), F.from_json(body, BODY))
    named_type = F.when(~body.startswith("{") & (body != ""), body)
    rules = entries.where(F.coalesce(F.col("field"), F.lit("")) != "").select(
        key, "pos", "field",
        F.coalesce(spec["type"], named_type, hinted_type(F.col("field"))).alias("type"),
        F.coalesce(spec["required"], F.lit(False)).alias("required"),
        F.coalesce(spec["aliases"], F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(spec["allowed"], F.array().cast("array<string>")).alias("allowed"),
    )
    return (
        rules.groupBy(key, "field")
        .agg(F.min("pos").alias("ord"), F.max(F.struct("pos", "type", "required", "aliases", "allowed")).alias("r"))
        .select(key, "ord", "field", "r.type", "r.required", "r.aliases", "r.allowed")
    )


def empty_schemas(declared: DataFrame, rules: DataFrame, key: str = "schema_id") -> DataFrame:
    """Schemas without any field: an error of the declaration."""
    return declared.join(rules.select(key).distinct(), key, "left_anti").select(
        key, F.lit("a target schema needs at least one field").alias("error")
    )


def derived_keys(declared: DataFrame, rules: DataFrame, key: str = "schema_id", text: str = "schema_json") -> DataFrame:
    """Primary key and match keys of each schema, declared or derived."""
    spec = declared.select(
        key,
        F.get_json_object(text, "$.primary_key").alias("pk_declared"),
        F.from_json(F.get_json_object(text, "$.match_keys"), "array<string>").alias("keys_declared"),
    )
    guessed = rules.groupBy(key).agg(
        F.min_by("field", F.when(F.lower("field").contains("id"), F.col("ord"))).alias("by_name"),
        F.min_by("field", "ord").alias("by_place"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("type") == "email", F.struct("ord", "field")))),
            lambda s: s["field"],
        ).alias("emails"),
    )
    pk = F.coalesce(F.when(F.col("pk_declared") != "", F.col("pk_declared")), "by_name", "by_place")
    out = guessed.join(spec, key).withColumn("primary_key", pk)
    own = F.when(F.size("keys_declared") > 0, F.col("keys_declared"))
    return out.select(
        key, "primary_key",
        F.coalesce(own, F.array_union("emails", F.array("primary_key"))).alias("match_keys"),
    )


def surface_rows(rules: DataFrame, key: str = "schema_id") -> DataFrame:
    """Raw spellings (field names and aliases); the last field to use one owns it."""
    spelled = rules.select(
        key, "ord", "field", F.posexplode(F.concat(F.array("field"), "aliases")).alias("pos", "surface")
    )
    return spelled.groupBy(key, "surface").agg(
        F.max_by("field", F.struct("ord", "pos")).alias("field"),
        F.min(F.struct("ord", "pos")).alias("at"),
    ).select(key, "surface", "field", F.col("at.ord").alias("ord"), F.col("at.pos").alias("pos"))


def variant_rows(declared: DataFrame, key: str = "schema_id", text: str = "schema_json") -> DataFrame:
    """(field, canonical, variant) of the declared enum spellings."""
    norm = F.from_json(F.get_json_object(text, "$.enum_normalization"), "map<string,map<string,array<string>>>")
    return (
        declared.select(key, F.explode(norm).alias("field", "m"))
        .select(key, "field", F.explode("m").alias("canonical", "spellings"))
        .select(key, "field", "canonical", F.explode("spellings").alias("variant"))
    )


def target_rule_rows(declared: DataFrame, key: str = "schema_id", text: str = "schema_json") -> DataFrame:
    """(kind, value, ord) of what the target system insists on."""
    def part(kind: str) -> DataFrame:
        values = F.from_json(F.get_json_object(text, f"$.target_system_rules.{kind}"), "array<string>")
        return declared.select(key, F.lit(kind).alias("kind"), F.posexplode(values).alias("ord", "value"))

    return part("blocked_email_domains").unionByName(part("required_fields"))


def schema_preview(declared: DataFrame, rules: DataFrame, key: str = "schema_id", text: str = "schema_json") -> DataFrame:
    """Per schema and field, what a person checks before a run."""
    heads = derived_keys(declared, rules, key, text).join(
        declared.select(
            key,
            F.coalesce(F.get_json_object(text, "$.entity"), F.lit("record")).alias("entity"),
            F.get_json_object(text, "$.display_field").alias("display_field"),
        ),
        key,
    )
    counts = rules.groupBy(key).agg(F.count("*").alias("field_count"))
    return rules.join(heads, key).join(counts, key)
