"""Column profiles: samples, counts and the dominant type of a column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import is_number, looks_like_date, not_blank


def long_cells(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per non-null cell: ``keep`` columns, column, value."""
    return (
        df.select(*keep, F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns
        ])).alias("cell"))
        .select(*keep, "cell.column", "cell.value")
        .where(F.col("value").isNotNull())
    )


# Parts of a column whose least places bound the places of its sample.
PLACES = 64


def column_samples(cells: DataFrame, size: int = DEFAULT.sample_size) -> DataFrame:
    """First ``size`` non-null values per (file, column) in file order.

    A column's rows are dealt into parts by a hash of their place. The ``size``-th of the least places of these
    parts is at or behind the last place of the sample, so only the few rows up to it are ranked: grouped minima
    are all that is held of a table of any size. A column that fills fewer parts is ranked as it is.
    """
    parts = max(PLACES, 4 * size)
    least = cells.groupBy("file", "column", F.pmod(F.xxhash64("row_idx"), F.lit(parts)).alias("part")).agg(F.min("row_idx").alias("least"))
    bounds = least.groupBy("file", "column").agg(F.get(F.array_sort(F.collect_list("least")), F.lit(size - 1)).alias("_last")).select(
        F.col("file").alias("_file"), F.col("column").alias("_column"), "_last")
    same = F.col("file").eqNullSafe(F.col("_file")) & F.col("column").eqNullSafe(F.col("_column"))
    ahead = F.col("_last").isNull() | F.col("row_idx").isNull() | (F.col("row_idx") <= F.col("_last"))
    w = Window.partitionBy("file", "column").orderBy("row_idx")
    early = cells.join(bounds, same).where(ahead).select(*cells.columns)
    return early.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= size)


def bottom_values(df: DataFrame, keys: list[str], value: str, size: int = DEFAULT.sample_size) -> DataFrame:
    """(keys, pos, value): up to ``size`` distinct values per group, those with the smallest digests.

    Which values come out does not depend on order or layout, and samples of parts merge into the sample of
    the whole. Spark limits the rank in each input partition first, so a group of any size ships ``size``
    distinct values a partition.
    """
    w = Window.partitionBy(*keys).orderBy(F.md5(F.col(value).cast("binary")), value)
    return df.where(F.col(value).isNotNull()).select(*keys, value).withColumn("pos", F.dense_rank().over(w)).where(F.col("pos") <= size).distinct()


def listed(picked: DataFrame, keys: list[str], value: str = "value", name: str = "samples") -> DataFrame:
    """The values of a sample as an array in order of ``pos``."""
    return picked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(name))


def open_samples(sources: list[tuple[str, DataFrame]], size: int = DEFAULT.sample_size) -> Callable[[DataFrame], DataFrame]:
    """A function from columns (file, header) to (file, header, samples); reads those columns only."""

    def run(wanted: DataFrame) -> DataFrame:
        by_file: dict[str, list[str]] = {}
        for r in wanted.select("file", "header").distinct().collect():  # headers that wait for a decision
            by_file.setdefault(r["file"], []).append(r["header"])
        parts = [
            long_cells(df.withColumn("file", F.lit(name)), sorted(by_file[name]), ["file", "row_idx"]) for name, df in sources if name in by_file
        ]
        if not parts:
            return wanted.select("file", "header", F.array().cast("array<string>").alias("samples")).limit(0)
        cells = reduce(DataFrame.unionByName, parts)
        return listed(column_samples(cells, size), ["file", "column"]).withColumnRenamed("column", "header")

    return run


def non_empty_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count per (file, column): one pass with partial counts."""
    counted = df.groupBy("file").agg(
        *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]
    )
    return counted.select(
        "file",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("non_empty")) for c in columns
        ])).alias("r"),
    ).select("file", "r.column", "r.non_empty")



def dominant_type(value: Column) -> Column:
    """Aggregate: type of a column from its values, blank ones ignored."""
    v = F.when(not_blank(value), value)

    def part(pred: Column) -> Column:
        return F.avg(F.when(v.isNotNull(), F.when(pred, 1.0).otherwise(0.0)))

    return (
        F.when(F.count(v) == 0, "empty")
        .when(part(v.contains("@")) >= 0.6, "email")
        .when(part(looks_like_date(v)) >= 0.6, "date")
        .when(part(is_number(v)) >= 0.8, "number")
        .otherwise("string")
    )


def classify(samples: DataFrame) -> DataFrame:
    return samples.groupBy("file", "column").agg(dominant_type(F.col("value")).alias("inferred_type"))


def file_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per (file, column): inferred type, non-null count and up to five samples."""
    cells = long_cells(df, columns, ["file", "row_idx"])
    picked = column_samples(cells)
    summary = picked.groupBy("file", "column").agg(
        dominant_type(F.col("value")).alias("inferred_type"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]
        ).alias("samples"),
    )
    return (
        non_empty_counts(df, columns)
        .join(summary, ["file", "column"], "left")
        .select(
            "file",
            "column",
            F.coalesce("inferred_type", F.lit("empty")).alias("inferred_type"),
            "non_empty",
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
    )
