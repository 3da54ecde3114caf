"""Day/month order of each source, taken from its own unambiguous values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import LABELS, day_under, label_of, read_as, with_days
from ..schema import TargetSchema


def inferred_orders(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(file, field, label) where all anchor values of a column agree.

    A value anchors the order when exactly one convention accepts it. Only a minimum
    and a maximum per column are kept, combined before the shuffle.
    """
    read = with_days(rows.select("file", *fields), {f"{f}__days": f for f in fields})
    # A blank text has no reading under any convention.
    places = read.select("file", *[label_of(F.col(f"{f}__days")).alias(f) for f in fields])
    ends = places.groupBy("file").agg(
        *[F.min(f).alias(f"{f}__lo") for f in fields], *[F.max(f).alias(f"{f}__hi") for f in fields]
    )
    names = F.array(*[F.lit(x) for x in LABELS])
    per_field = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.when(F.col(f"{f}__lo") == F.col(f"{f}__hi"), F.get(names, F.col(f"{f}__lo") - 1)).alias(
                    "label"
                ),
            )
            for f in fields
        ]
    )
    return (
        ends.select("file", F.explode(per_field).alias("r"))
        .select("file", "r.field", "r.label")
        .where(F.col("label").isNotNull())
    )


def wide_orders(orders: DataFrame, fields: list[str]) -> DataFrame:
    """One row per file with the label of each date field."""
    return orders.groupBy("file").agg(
        *[F.max(F.when(F.col("field") == f, F.col("label"))).alias(f"{f}__label") for f in fields]
    )


def rewritten(value: Column, label: Column) -> Column:
    """ISO text under the label; values it does not explain stay as they are."""
    return F.when(label.isNotNull(), F.coalesce(read_as(value, label), value)).otherwise(value)


def rewrite_dates(rows: DataFrame, orders: DataFrame, schema: TargetSchema) -> DataFrame:
    """Rewrite each file's date values with its own order.

    ``orders`` is a stored table with one row per file and date column, so Spark knows
    its size: it is broadcast below Spark's limit and joined by key above it.
    """
    fields = schema.of_type("date")
    if not fields:
        return rows
    read = with_days(rows, {f"{f}__days": f for f in fields})
    joined = read.join(wide_orders(orders, fields), "file", "left")
    # Without a label, the value stays as it is.
    day = {f: F.when(F.col(f"{f}__label").isNotNull(), day_under(F.col(f"{f}__days"), F.col(f"{f}__label"))) for f in fields}
    return joined.select(*[F.coalesce(day[c], c).alias(c) if c in fields else F.col(c) for c in rows.columns])
