"""Rules of the target schema, at most one error per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_iso_day
from ..functions.text import is_email, is_number, not_blank, strip
from ..schema import Field, TargetSchema
from .cleaning import entries


def broken_rule(f: Field) -> Column:
    """Text of the first rule the field breaks, else null."""
    v = F.col(f.name)
    missing = ~not_blank(v)
    rule = F.lit(None).cast("string")
    if f.type == "email":
        rule = F.when(~is_email(v), "invalid email")
    elif f.type == "date":
        rule = F.when(~is_iso_day(v), "invalid date (expected YYYY-MM-DD)")
    elif f.type == "number":
        rule = F.when(~is_number(v), "invalid number")
    elif f.type == "enum" and f.allowed:
        listed = "[" + ", ".join(f"'{a}'" for a in f.allowed) + "]"
        rule = F.when(~strip(v).isin(*f.allowed), f"not an allowed value {listed}")
    absent = F.lit("required field missing") if f.required else F.lit(None).cast("string")
    return F.when(missing, absent).otherwise(rule)


def with_errors(df: DataFrame, schema: TargetSchema) -> DataFrame:
    """Add ``errors``: array of field, error, value. A projection, after one that tells the broken rules."""
    broken = {f.name: F.col(f"{f.name}__broken") for f in schema}
    checks = [
        F.when(
            broken[f.name].isNotNull(),
            F.struct(
                F.lit(f.name).alias("field"), broken[f.name].alias("error"),
                F.when(not_blank(F.col(f.name)), strip(F.col(f.name))).otherwise(F.col(f.name)).alias("value"),
            ),
        )
        for f in schema
    ]
    told = df.withColumns({f"{f.name}__broken": broken_rule(f) for f in schema})
    return told.withColumn("errors", F.array_compact(F.array(*checks))).drop(*[f"{f.name}__broken" for f in schema])


def without_pending(errors: Column, pending: Column) -> Column:
    """Drop the errors of fields that wait for a date decision anyway."""
    waiting = F.transform(pending, lambda p: p["field"])
    return F.filter(errors, lambda e: ~F.array_contains(waiting, e["field"]))


def error_rows(df: DataFrame, key: str = "natural_key") -> DataFrame:
    return entries(df, key, "errors")
