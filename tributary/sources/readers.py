"""Exports as DataFrames of strings, with their place in the source order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..operators.questions import union_all
from ..session import stage
from . import records

# Cell texts that mean "no value".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
ROW_BITS = 33
ODD = "_odd"
LATIN = "ISO-8859-1"


def null_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn every cell that spells "no value" into null. A projection."""
    own = set(columns or df.columns)
    tokens = ", ".join(quoted(t) for t in NULL_TOKENS)
    return df.selectExpr(
        *[f"CASE WHEN `{c}` NOT IN ({tokens}) THEN `{c}` END AS `{c}`" if c in own else f"`{c}`" for c in df.columns]
    )


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop("all", subset=[f"`{c}`" for c in columns])


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def dense_index(df: DataFrame, order: list[Column], name: str = "row_idx") -> DataFrame:
    """Number the rows 0, 1, 2 … in the given order without one task seeing them all.

    Rows are range-partitioned and stored with their place inside the partition; the
    offsets of the partitions are a running sum over one row per partition.
    """
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = stage(placed, "ordered")
    part = F.shiftright(F.col("_at"), ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the stored table: bounded by the number of partitions.
    offsets = sizes.selectExpr(
        "_part", "sum(_n) over (order by _part rows between unbounded preceding and 1 preceding) as _offset"
    )
    inside = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.coalesce(F.col("_offset"), F.lit(0)) + inside)
        .drop("_at", "_part", "_offset")
    )


def _odd_files(splits: DataFrame) -> list[tuple[str, bool, bool]]:
    """(file, has cells with line breaks, is UTF-8) of the files that are not plain; one row a file."""
    per_file = splits.groupBy("path").agg(F.bool_or("breaks").alias("breaks"), F.bool_and("utf8").alias("utf8"))
    return [(r["path"], r["breaks"], r["utf8"]) for r in per_file.where(F.col("breaks") | ~F.col("utf8")).collect()]


def csv_layout(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, has line breaks inside quotes) of an export."""
    odd = _odd_files(records.layout(spark, path))
    return ("UTF-8" if all(utf8 for *_, utf8 in odd) else LATIN), any(breaks for _, breaks, _ in odd)


def csv_rows(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Raw rows with their place, and with the whole text of those that have too many cells.

    Every file is read in splits. Files with line breaks inside cells are cut into records first;
    one such file, or one in another encoding, leaves the others as they are. With ``names``, files
    of unlike headers are read at once and their headers come as rows.
    """
    headed = names is None
    splits = stage(records.layout(spark, path), "csv-layout")
    odd = _odd_files(splits)
    options = {
        "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    reader = spark.read.option("header", True).options(**options)
    latin = [f for f, _, utf8 in odd if not utf8]
    breaks = any(b for _, b, _ in odd)
    if names is None:
        names = reader.option("multiLine", breaks).option("encoding", LATIN if latin and len(latin) == len(odd) else "UTF-8").csv(path).columns
    fields = ", ".join(f"`{c}` string" for c in [*names, ODD])
    # A line of another length than the header's is kept as text; one that is short is no error.
    cells = F.length(F.regexp_replace(F.regexp_replace(ODD, '"[^"]*"', ""), "[^,]", "")) + 1
    columns = [*[F.col(f"`{c}`") for c in names], F.when(cells > len(names), F.col(ODD)).alias(ODD)]

    def plain(encoding: str, wanted: Column) -> DataFrame:
        raw = (
            spark.read.option("header", headed).options(**options).option("encoding", encoding)
            .schema(fields).option("columnNameOfCorruptRecord", ODD).csv(path)
        )
        return raw.where(wanted).select(
            *columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
        )

    def broken(encoding: str, files: list[str]) -> DataFrame:
        first = Window.partitionBy("path").orderBy("start", "line")
        found = records.records(spark, path, splits, files, encoding)
        body = found.where(F.trim("value") != "")
        if headed:
            heads = found.where("start = 0").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("path", "start", "line")
            body = body.join(heads, ["path", "start", "line"], "left_anti")
        cut = F.from_csv("value", F.lit(fields), {**options, "columnNameOfCorruptRecord": ODD, "maxCharsPerColumn": "-1"})
        return body.select(cut.alias("r"), "path", "start", "line").select(
            "r.*", F.col("path").alias("_path"), F.col("start").alias("_start"), F.col("line").alias("_line")
        ).select(*columns, "_path", "_start", "_line")

    file = F.col("_metadata.file_path")
    parts = [plain("UTF-8", ~file.isin([f for f, *_ in odd]) if odd else F.lit(True))]
    for encoding in ("UTF-8", LATIN):
        own = [(f, b) for f, b, utf8 in odd if utf8 == (encoding == "UTF-8")]
        if any(not b for _, b in own):
            parts.append(plain(encoding, file.isin([f for f, b in own if not b])))
        if any(b for _, b in own):
            parts.append(broken(encoding, [f for f, b in own if b]))
    return union_all(parts), names


def read_csv_export(spark: SparkSession, path: str, ragged: str = "fail") -> DataFrame:
    """One CSV export: all strings, blanks kept, tokens nulled, empty rows dropped.

    A row with more cells than the header makes the job fail, unless ``ragged`` is
    "apart": then it is left to :func:`csv_errors`. No cell is dropped without a trace.
    """
    order, names = csv_rows(spark, path)
    odd = F.col(ODD)
    if ragged == "apart":
        order = order.where(odd.isNull())
    else:
        refused = F.raise_error(F.concat(F.lit("more cells than the header: "), odd)).cast("boolean")
        order = order.where(F.when(odd.isNull(), True).otherwise(refused))
    kept = drop_empty_rows(null_tokens(order.drop(ODD), names), names)
    indexed = dense_index(kept, [F.col("_path"), F.col("_start"), F.col("_line")])
    return normalize_headers(indexed.select(*[F.col(f"`{c}`") for c in names], "row_idx"))


def csv_errors(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells, expected) of the rows with more cells than the header.

    ``line`` is the row's whole text, ``cells`` those that the header names.
    """
    rows, names = csv_rows(spark, path)
    return rows.where(F.col(ODD).isNotNull()).select(
        F.col(ODD).alias("line"), F.array(*[F.col(f"`{c}`") for c in names]).alias("cells"),
        F.lit(len(names)).alias("expected"),
    )


def with_lineage(df: DataFrame, file: str, file_ord: int) -> DataFrame:
    return df.select(F.lit(file).alias("file"), F.lit(file_ord).alias("file_ord"), "*")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All sources as one frame, already in target fields. A union needs no shuffle."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def source_catalog(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per file: position, row count and ordered column list."""
    parts = []
    for i, (name, df) in enumerate(sources):
        columns = [c for c in df.columns if c != "row_idx"]
        parts.append(
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("file"), F.lit(i).alias("file_ord"), "row_count",
                F.array(*[F.lit(c) for c in columns]).alias("columns"),
            )
        )
    return union_all(parts)


def column_catalog(catalog: DataFrame) -> DataFrame:
    """One row per (file, column) with its position."""
    return catalog.select("file", "file_ord", F.posexplode("columns").alias("col_ord", "header"))
