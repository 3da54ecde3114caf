"""Many exports at once: one scan, whatever the number of files and of different headers.

The cells of a row stay an array. What a file's columns mean is data, one row per file, joined to the
rows; so the plan of a run over ten thousand files is that of a run over three.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profiling import column_samples, listed
from ..schema import TargetSchema
from ..session import stage
from .readers import NULL_TOKENS, ODD, csv_rows, dense_index


class Exports(NamedTuple):
    """``rows``: file, file_ord, row_idx, cells. ``catalog``: file, file_ord, row_count, columns."""

    rows: DataFrame
    catalog: DataFrame


def _width(spark: SparkSession, path: str) -> int:
    """Cells of the longest line that is a header: quoted cells count once."""
    bare = F.regexp_replace(F.regexp_replace("value", '"[^"]*"', ""), "[^,]", "")
    lines = (
        spark.read.option("lineSep", "\n").text(path).where(F.col("_metadata.file_block_start") == 0)
        .select(F.col("_metadata.file_path").alias("path"), F.length(bare).alias("commas"), F.monotonically_increasing_id().alias("line"))
    )
    first = lines.groupBy("path").agg(F.min_by("commas", "line").alias("commas"))
    return (first.agg(F.max("commas")).first()[0] or 0) + 1


def read_exports(spark: SparkSession, path: str, name: str = "[^/]+$") -> Exports:
    """All CSV files under ``path``: tokens nulled, empty rows dropped, rows numbered within their file.

    A file is called by what the pattern ``name`` finds in its path.

    A row with more cells than its own header stops the job: no cell is dropped without a trace.
    """
    width = _width(spark, path)
    raw, names = csv_rows(spark, path, [f"c{i}" for i in range(width)])
    cells = F.array(*[F.col(n) for n in names])
    order = ["_path", "_start", "_line"]
    rows = stage(raw.select(*order, cells.alias("cells"), F.col(ODD).alias("odd")), "cells")
    heads = rows.groupBy("_path").agg(F.min_by(F.struct("cells", *order[1:]), F.struct(*order[1:])).alias("h"))
    # One row a file.
    named = F.transform(F.filter("h.cells", lambda c, i: i < F.greatest(*[F.when(F.col("h.cells")[j].isNotNull(), j + 1).otherwise(0) for j in range(width)], F.lit(0))),
                        lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\ufeff", "")))
    files = stage(
        heads.select("_path", named.alias("columns"), F.col("h._start").alias("_hs"), F.col("h._line").alias("_hl"))
        .withColumn("file", F.regexp_extract("_path", name, 0))
        .withColumn("file_ord", (F.row_number().over(Window.orderBy("file", "_path")) - 1).cast("int")), "files",
    )
    values = F.transform("cells", lambda v: F.when(~v.isin(NULL_TOKENS), v))
    beyond = F.exists(F.slice("cells", F.size("columns") + 1, width), lambda v: v.isNotNull()) | F.col("odd").isNotNull()
    refused = F.raise_error(F.concat(F.lit("more cells than the header in "), F.col("file"))).cast("boolean")
    body = (
        rows.join(files, "_path").where((F.col("_start") != F.col("_hs")) | (F.col("_line") != F.col("_hl")))
        .where(F.when(beyond, refused).otherwise(True))
        .withColumn("cells", values).where(F.exists("cells", lambda v: v.isNotNull()))
        .select("file", "file_ord", "_start", "_line", "cells")
    )
    placed = stage(dense_index(body, [F.col("file_ord"), F.col("_start"), F.col("_line")], "at"), "placed")
    sizes = placed.groupBy("file_ord").agg(F.min("at").alias("first"), F.count("*").alias("row_count"))
    out = placed.join(sizes.select("file_ord", "first"), "file_ord").select(
        "file", "file_ord", (F.col("at") - F.col("first")).alias("row_idx"), "cells")
    catalog = files.join(sizes, "file_ord", "left").select(
        "file", "file_ord", F.coalesce("row_count", F.lit(0)).alias("row_count"), "columns")
    return Exports(out, stage(catalog, "catalog"))


def open_samples(exports: Exports, columns: DataFrame, size: int) -> Callable[[DataFrame], DataFrame]:
    """A function from columns (file, header) to (file, header, samples); only their cells are taken apart."""

    def run(wanted: DataFrame) -> DataFrame:
        places = columns.join(wanted.distinct(), ["file", "header"], "left_semi").groupBy("file").agg(
            F.collect_list(F.struct("col_ord", "header")).alias("open"))
        cells = exports.rows.join(places, "file").select("file", "row_idx", "cells", F.explode("open").alias("o")).select(
            "file", "row_idx", F.col("o.header").alias("column"), F.get("cells", F.col("o.col_ord")).alias("value")
        ).where(F.col("value").isNotNull())
        return listed(column_samples(cells, size), ["file", "column"]).withColumnRenamed("column", "header")

    return run


def map_exports(exports: Exports, mappings: DataFrame, schema: TargetSchema) -> DataFrame:
    """Rows of all files in target fields. Of several columns for a field, the last that is not null wins."""
    settled = mappings.where(F.col("status").isin("auto_applied", "resolved") & F.col("target_field").isNotNull())

    def places(field: str) -> Column:
        own = F.collect_list(F.when(F.col("target_field") == field, F.col("col_ord")))
        return F.reverse(F.array_sort(own)).alias(field)

    # One row a file: arrays are as long as its header at most.
    layout = settled.groupBy("file").agg(*[places(n) for n in schema.names])
    joined = exports.rows.alias("r").join(layout.alias("l"), "file", "left")
    value = lambda n: F.get(F.filter(F.transform(F.col(f"l.{n}"), lambda p: F.get(F.col("r.cells"), p)), lambda v: v.isNotNull()), F.lit(0))
    return joined.select("file", "file_ord", "row_idx", *[value(n).alias(n) for n in schema.names])
