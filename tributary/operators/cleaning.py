"""Safe automatic fixes. Every step is a projection and reports what it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_under, days_of, formats_in, only_day, two_days, with_days
from ..functions.text import (
    is_email,
    is_number,
    literal_lookup,
    phone,
    squeeze,
    strip,
    title_case,
    without_commas,
)
from ..schema import Field, TargetSchema

# Reasons of changes, as they stand in the audit trail.
REASONS = {
    "both": "trimmed whitespace and normalized casing",
    "cased": "casing normalized",
    "spaced": "trimmed whitespace/collapsed spacing",
    "iso": "date normalized to ISO",
    "enum": "enum normalization",
    "phone": "phone normalized",
    "email": "auto-fixed email casing/spacing",
    "number": "stripped thousands separators",
}


def change(field: str, before: Column, after: Column, reason: Column | str, when: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(field).alias("field"),
            before.alias("before"),
            after.alias("after"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        ),
    )


def tidy(field: Field, value: Column, schema: TargetSchema) -> Column:
    squeezed = squeeze(value)
    return title_case(squeezed) if field.name in schema.title_case_fields else squeezed


def tidy_reason(before: Column, after: Column) -> Column:
    spaced = squeeze(before) != before
    cased = after != squeeze(before)
    return (
        F.when(spaced & cased, REASONS["both"])
        .when(cased, REASONS["cased"])
        .otherwise(REASONS["spaced"])
    )


def canonical(field: Field, value: Column, schema: TargetSchema) -> Column:
    """Canonical enum value, or the value itself when no spelling matches."""
    table = schema.enum_variants(field.name, with_canonical=True)
    return F.coalesce(literal_lookup(table, F.lower(squeeze(value))), value)


def iso_date(field: Field, value: Column, forced: dict[str, str], days: Column | None = None) -> Column:
    """ISO text when the value has one reading or its format was decided. ``days`` are its readings, if at hand."""
    label = forced.get(field.name)
    day = (lambda d: day_under(d, label)) if label else only_day
    return F.coalesce(days_of(value, day) if days is None else day(days), value)


def date_reason(field: Field, forced: dict[str, str]) -> str:
    label = forced.get(field.name)
    return f"date normalized via decided format {label}" if label else REASONS["iso"]


def is_ambiguous(field: Field, value: Column, forced: dict[str, str], days: Column | None = None) -> Column:
    if field.name in forced:
        return F.lit(False)
    return days_of(value, two_days) if days is None else two_days(days)


def normal_phone(value: Column) -> Column:
    fixed = phone(value)
    return F.when(fixed != "", fixed).otherwise(value)


def fixed_email(value: Column) -> Column:
    """Lower-cased and without spaces, when only that makes the address valid."""
    squeezed = F.replace(F.lower(strip(value)), F.lit(" "), F.lit(""))
    return F.when(~is_email(value) & is_email(squeezed), squeezed).otherwise(value)


def fixed_number(value: Column) -> Column:
    bare = without_commas(strip(value))
    return F.when(is_number(value) & (bare != strip(value)), bare).otherwise(value)


def _filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def clean_records(
    records: DataFrame,
    schema: TargetSchema,
    forced: dict[str, str] | None = None,
    auto_fix: bool = True,
) -> DataFrame:
    """Blanks and casing, enums, dates, phones, then the automatic fixes.

    Adds ``changes`` (array of field, before, after, reason) and ``pending_dates``
    (array of field, raw, options). One narrow stage, no shuffle.
    """
    forced = forced or {}
    log: list[str] = []
    df = records

    def step(source: DataFrame, tag: str, fields: list[Field], fix, reason) -> DataFrame:
        """One fix over some fields: the old value is kept only for the change log."""
        if not fields:
            return source
        new = {f.name: fix(f, F.col(f.name)) for f in fields}
        moved = source.withColumns({f"{f.name}__{tag}": F.col(f.name) for f in fields}).withColumns(new)
        entries = F.array_compact(
            F.array(
                *[
                    change(
                        f.name, F.col(f"{f.name}__{tag}"), F.col(f.name),
                        reason(f), F.col(f"{f.name}__{tag}") != F.col(f.name),
                    )
                    for f in fields
                ]
            )
        )
        log.append(f"_log_{tag}")
        return moved.withColumn(f"_log_{tag}", entries).drop(*[f"{f.name}__{tag}" for f in fields])

    every = list(schema)
    df = step(
        df, "tidy", every, lambda f, v: tidy(f, v, schema),
        lambda f: tidy_reason(F.col(f"{f.name}__tidy"), F.col(f.name)),
    )
    df = step(
        df, "enum", [f for f in every if schema.variants.get(f.name)],
        lambda f, v: F.when(_filled(v), canonical(f, v, schema)).otherwise(v),
        lambda f: REASONS["enum"],
    )
    dates = [f for f in every if f.type == "date"]
    days = {f.name: F.col(f"{f.name}__days") for f in dates}
    df = with_days(df, {f"{f.name}__days": f.name for f in dates}) if dates else df
    pending = F.array_compact(
        F.array(
            *[
                F.when(
                    is_ambiguous(f, F.col(f.name), forced, days[f.name]),
                    F.struct(
                        F.lit(f.name).alias("field"),
                        F.col(f.name).alias("raw"),
                        formats_in(days[f.name]).alias("options"),
                    ),
                )
                for f in dates
            ]
        )
    )
    empty = "array<struct<field:string,raw:string,options:array<struct<format:string,parsed:string>>>>"
    df = df.withColumn("pending_dates", pending if dates else F.array().cast(empty))
    df = step(
        df, "date", dates, lambda f, v: iso_date(f, v, forced, days[f.name]), lambda f: date_reason(f, forced)
    ).drop(*[f"{f.name}__days" for f in dates])
    df = step(
        df, "phone", [f for f in every if f.name in schema.phone_fields],
        lambda f, v: F.when(_filled(v), normal_phone(v)).otherwise(v),
        lambda f: REASONS["phone"],
    )
    if auto_fix:
        df = step(
            df, "email", [f for f in every if f.type == "email"],
            lambda f, v: fixed_email(v), lambda f: REASONS["email"],
        )
        df = step(
            df, "number", [f for f in every if f.type == "number"],
            lambda f, v: fixed_number(v), lambda f: REASONS["number"],
        )
    return df.withColumn("changes", F.concat(*[F.col(c) for c in log])).drop(*log)


def entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per entry of an array of structs, beside the key.

    The array is worked out once per row: before a plain explode, Spark filters by its size, and such a filter
    works out every step of the array once more, each as often as the next one mentions it.
    """
    told = df.select(key, F.explode_outer(column).alias("c")).where(F.col("c").isNotNull())
    return told.select(key, "c.*")


def change_log(cleaned: DataFrame, key: str = "natural_key") -> DataFrame:
    return entries(cleaned, key, "changes")


def renormalize_enums(df: DataFrame, schema: TargetSchema) -> DataFrame:
    """Bring values set by hand to their canonical spelling."""
    own = [f for f in schema if schema.variants.get(f.name)]
    return df.withColumns({f.name: canonical(f, F.col(f.name), schema) for f in own}) if own else df
