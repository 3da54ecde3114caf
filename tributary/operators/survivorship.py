"""Merge the rows of an entity field by field, with provenance and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import distinct_days, is_readable, read_as, readings
from ..functions.similarity import bind
from ..functions.text import digits, literal_lookup, not_blank, squeeze
from ..schema import Field, TargetSchema

CELL = "struct<file_ord:int,row_idx:bigint,file:string,raw:string>"


def cell(name: str) -> Column:
    """A value with its place in the source order; null for blank values."""
    return F.when(
        not_blank(F.col(name)),
        F.struct(
            F.col("file_ord").cast("int").alias("file_ord"),
            F.col("row_idx").cast("bigint").alias("row_idx"),
            F.col("file").alias("file"),
            F.col(name).alias("raw"),
        ),
    )


def keep_cells(linked: DataFrame, schema: TargetSchema) -> DataFrame:
    """Per entity and field, the surviving cell.

    The first non-blank value in source order survives; in an e-mail field the first
    value with an at sign goes before a value without one. Minimum aggregates combine
    on the map side, so an entity with very many rows shuffles one row per partition.
    """
    aggs = []
    for f in schema:
        aggs.append(F.min(cell(f.name)).alias(f"{f.name}__first"))
        if f.type == "email":
            aggs.append(F.min(F.when(F.col(f.name).contains("@"), cell(f.name))).alias(f"{f.name}__at"))
    grouped = linked.groupBy("entity_id").agg(
        F.count("*").alias("n_rows"), F.min(F.struct("file_ord", "row_idx", "file")).alias("origin"), *aggs
    )
    out = [F.col("entity_id"), F.col("n_rows"), F.col("origin.file").alias("origin_file")]
    for f in schema:
        first = F.col(f"{f.name}__first")
        kept = F.coalesce(F.col(f"{f.name}__at"), first) if f.type == "email" else first
        out.append(kept.alias(f"{f.name}__kept"))
        if f.type == "email":
            out.append(first.alias(f"{f.name}__first"))
    return grouped.select(*out)


def merged_records(kept: DataFrame, schema: TargetSchema) -> DataFrame:
    """Wide merged record: raw surviving values and a provenance map."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{n}__kept").isNotNull(),
                    F.struct(
                        F.lit(n).alias("key"),
                        F.struct(
                            F.col(f"{n}__kept.file").alias("file"), F.col(f"{n}__kept.raw").alias("raw")
                        ).alias("value"),
                    ),
                )
                for n in schema.names
            ]
        )
    )
    return kept.select(
        "entity_id",
        "n_rows",
        "origin_file",
        *[F.col(f"{n}__kept.raw").alias(n) for n in schema.names],
        F.map_from_entries(entries).alias("provenance"),
    )


def provenance_rows(records: DataFrame) -> DataFrame:
    """One row per entity and filled field: value and source file."""
    return records.select("entity_id", F.explode("provenance").alias("field", "source")).select(
        "entity_id", "field", F.col("source.file").alias("file"), F.col("source.raw").alias("raw")
    )


def equivalent(
    field: Field, a: Column, b: Column, schema: TargetSchema, forced: dict[str, str] | None = None
) -> Column:
    """True when two raw values state the same fact in different spellings."""
    sa, sb = squeeze(a), squeeze(b)
    # Often only the case differs: then no blanks need to be looked for.
    same = (F.lower(a) == F.lower(b)) | (F.lower(sa) == F.lower(sb))
    if field.type == "date":
        label = (forced or {}).get(field.name)
        if label:
            rest = F.coalesce(read_as(sa, label) == read_as(sb, label), F.lit(False))
        else:
            # One side has a single reading and it is among those of the other side.
            rest = bind(
                F.struct(distinct_days(sa).alias("a"), distinct_days(sb).alias("b")),
                lambda d: (F.least(F.size(d["a"]), F.size(d["b"])) == 1) & F.arrays_overlap(d["a"], d["b"]),
            )
        return F.when(same, True).otherwise(F.coalesce(rest, F.lit(False)))
    rest = F.lit(False)
    if field.type == "enum" and schema.variants.get(field.name):
        table = schema.enum_variants(field.name, with_canonical=True)
        canon = lambda v: literal_lookup(table, F.lower(v))
        rest = rest | F.coalesce(canon(sa) == canon(sb), F.lit(False))
    if field.name == schema.primary_key:
        rest = rest | ((digits(sa) != "") & (digits(sa) == digits(sb)))
    if field.type == "email":
        rest = rest | (sa.contains("@") != sb.contains("@"))
    return F.when(same, True).otherwise(rest)


def _place(c: Column) -> Column:
    return F.struct(c["file_ord"], c["row_idx"])


def distinct_rows(linked: DataFrame, schema: TargetSchema) -> DataFrame:
    """Rows of one entity and file that agree in every field, once: at their first place and, where it differs, their last.

    Exports repeat their rows, so this is a small part of them, and all that the comparison with the survivors
    depends on: a value's first place in a file, and whether it also comes after the survivor of its field.
    """
    places = F.array_distinct(F.array(F.min("row_idx"), F.max("row_idx")))
    once = linked.groupBy("entity_id", "file", "file_ord", *schema.names).agg(places.alias("places"))
    return once.select("entity_id", "file", "file_ord", F.explode("places").alias("row_idx"), *schema.names)


def disagreements(
    linked: DataFrame,
    kept: DataFrame,
    schema: TargetSchema,
    forced: dict[str, str] | None = None,
) -> DataFrame:
    """Long table of values that contradict the surviving value of their field.

    Each row is compared with the survivors of its entity only, never with the other
    rows, so Spark may split the partition of an entity with very many rows.
    """
    joined = linked.select("entity_id", "file", "file_ord", "row_idx", *schema.names).join(kept, "entity_id")
    found = []
    for f in schema:
        survivor = F.col(f"{f.name}__kept")
        rival = survivor
        if f.type == "email":
            # Until a value with an at sign turns up, values compare to the first one.
            before = _place(cell(f.name)) < _place(survivor)
            rival = F.when(before, F.col(f"{f.name}__first")).otherwise(survivor)
        differs = (
            (F.col(f.name) != rival["raw"])
            & not_blank(F.col(f.name))
            & ~equivalent(f, rival["raw"], F.col(f.name), schema, forced)
        )
        found.append(
            F.when(
                differs,
                F.struct(
                    F.lit(f.name).alias("field"),
                    F.lit(f.type).alias("type"),
                    rival["file"].alias("kept_file"),
                    rival["raw"].alias("kept_value"),
                    F.col("file").alias("file"),
                    F.col(f.name).alias("value"),
                ),
            )
        )
    # A projection of its own: inside the array, every comparison would run uncompiled.
    told = joined.select("entity_id", "file_ord", "row_idx", *[c.alias(f"{f.name}__differs") for f, c in zip(schema, found)])
    return told.select(
        "entity_id", "file_ord", "row_idx", F.explode(F.array_compact(F.array(*[F.col(f"{f.name}__differs") for f in schema]))).alias("c")
    ).select("entity_id", "file_ord", "row_idx", "c.*")


def distinct_disagreements(rows: DataFrame) -> DataFrame:
    """One row per entity, field and distinct value, at its first place."""
    firsts = rows.groupBy("entity_id", "field", "type", "kept_file", "kept_value", "value").agg(
        F.min(F.struct("file_ord", "row_idx", "file")).alias("at")
    )
    return firsts.select(
        "entity_id", "field", "type", "kept_file", "kept_value", "value",
        F.col("at.file").alias("file"), F.col("at.file_ord").alias("file_ord"), F.col("at.row_idx").alias("row_idx"),
    )


def is_date_question() -> Column:
    """A date disagreement with any readable side is a question about the format."""
    readable = is_readable(F.col("kept_value")) | is_readable(F.col("value"))
    return (F.col("type") == "date") & readable


def date_questions(rows: DataFrame) -> DataFrame:
    """(entity_id, field, raw, options) for the disagreements about a date format."""
    both = F.explode(F.array("kept_value", "value"))
    return rows.where(is_date_question()).select("entity_id", "field", both.alias("raw")).withColumn(
        "options", readings(F.col("raw"))
    )
