"""CSV records that run over line breaks, read in splits.

Whether a line begins inside quotes depends on all lines before it. Each line is a function of two
states, outside and inside quotes; functions compose in any grouping, so every split folds its own
lines and one row per split is enough to know in which state each split begins. Splits then cut
themselves into records. The pieces of a record that runs over a split's end, at most two a split,
are put together afterwards. Only lines with a quote, or with broken UTF-8, leave the first scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUT, IN = 0, 1
# A quoted cell at the start of a cell, closed; one that is not closed; and the end of one from an earlier line.
_CELL = re.compile(r'(?:(?<=,)|^)"[^"]*(?:""[^"]*)*"(?!")')
_OPEN = re.compile(r'(?:^|,)"')
_REST = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
WHOLE, HEAD, MIDDLE, TAIL = range(4)
_LAYOUT = "path string, start long, from_out int, from_in int, breaks boolean, utf8 boolean"
_PIECES = "path string, start long, line long, piece int, value string"


def _opens(line: str) -> int:
    """The state behind a line, or the rest of one, that begins outside quotes."""
    return IN if _OPEN.search(_CELL.sub("", line)) else OUT


def behind(line: str, state: int) -> int:
    """The state of quotes behind a line."""
    if '"' not in line:
        return state
    if state == OUT:
        return _opens(line)
    closed = _REST.match(line)
    return _opens("x" + line[closed.end() :]) if closed else IN


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding).alias("value")
    return (
        spark.read.option("lineSep", "\n").text(path)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"), value,
        )
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for (path, start), lines in groupby(_rows(batches), itemgetter(0, 1)):
        states, breaks, utf8 = [OUT, IN], False, True
        for _, _, value, valid in lines:
            states = [behind(value, s) for s in states]
            breaks, utf8 = breaks or behind(value, OUT) == IN, utf8 and valid
        out.append((path, start, *states, breaks, utf8))
    if out:
        yield _batch(out, _LAYOUT)


# Arrow's types of the columns here.
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [part.split() for part in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), named, strict=True)], [n for n, _ in named]
    )


def layout(spark: SparkSession, path: str) -> DataFrame:
    """One row for each split that has a quote or is not UTF-8: what it makes of either state, and whether a line breaks a cell."""
    valid = F.is_valid_utf8("value")
    told = _lines(spark, path).where(F.contains("value", F.lit('"')) | ~valid)
    return told.select("path", "start", F.make_valid_utf8("value").alias("value"), valid.alias("valid")).mapInArrow(_fold, _LAYOUT)


def _begins(splits: DataFrame) -> DataFrame:
    """(path, start, state) in which each split of ``layout`` begins.

    A split whose result does not depend on its own begin settles what comes before it; those that
    swap or keep the state are counted from there.
    """
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_out") == F.col("from_in")
    swaps = F.sum((F.col("from_out") == IN).cast("int") * (~fixed).cast("int"))
    counted = splits.select("path", "start", "from_out", fixed.alias("fixed"), swaps.over(order).alias("swaps"))
    last = F.last(F.when(F.col("fixed"), F.struct("from_out", "swaps")), ignorenulls=True).over(before)
    here = F.coalesce(F.lag("swaps").over(order), F.lit(0))
    return counted.withColumn("last", last).withColumn("here", here).select(
        "path", "start",
        F.when(F.col("last").isNull(), F.col("here") % 2)
        .otherwise((F.col("last.from_out") + F.col("here") - F.col("last.swaps")) % 2).cast("int").alias("state"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for (path, start), lines in groupby(_rows(batches), itemgetter(0, 1)):
        state, held, at = None, [], 0
        begun = False  # the record in hand began in this split
        for _, _, line, value, begin in lines:
            if state is None:
                state, begun = begin, begin == OUT
            if not held:
                at = line
            held.append(value)
            state = behind(value, state)
            if state == OUT:
                out.append((path, start, at, WHOLE if begun else TAIL, "\n".join(held)))
                held, begun = [], True
            if len(out) > 5000:
                yield _batch(out, _PIECES)
                out = []
        if held:
            out.append((path, start, at, HEAD if begun else MIDDLE, "\n".join(held)))
    if out:
        yield _batch(out, _PIECES)


def records(spark: SparkSession, path: str, splits: DataFrame, files: list[str], encoding: str) -> DataFrame:
    """(path, start, line, value): the records of some files, those of the header included, in order of the last two.

    ``splits`` is the stored table of :func:`layout`. A split without a row there keeps the state
    it begins in: that of the split before it.
    """
    own = splits.where(F.col("path").isin(files)).select("path", "start", "from_out", "from_in")
    lines = _lines(spark, path, encoding).where(F.col("path").isin(files))
    # All splits of these files, one row each; those that kept their state have none in the layout.
    every = lines.select("path", "start").distinct().join(own, ["path", "start"], "left").fillna({"from_out": OUT, "from_in": IN})
    cut = lines.join(_begins(every), ["path", "start"]).select("path", "start", "line", "value", "state")
    return _joined(_in_order(cut).mapInArrow(_cut, _PIECES))


def _in_order(lines: DataFrame) -> DataFrame:
    """Lines of a split side by side, in order, whichever join brought them their state."""
    return lines.repartition("path", "start").sortWithinPartitions("path", "start", "line")


def _joined(pieces: DataFrame) -> DataFrame:
    from ..session import stage

    pieces = stage(pieces, "records")
    order = Window.partitionBy("path").orderBy("start", "line")
    chain = F.sum((F.col("piece") == HEAD).cast("int")).over(order)
    part = F.struct("start", "line", "value")
    long = (
        pieces.where(F.col("piece") != WHOLE).withColumn("chain", chain)
        .groupBy("path", "chain").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select("path", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["line"].alias("line"),
                F.array_join(F.col("parts.value"), "\n").alias("value"))
    )
    whole = pieces.where(F.col("piece") == WHOLE).select("path", "start", "line", "value")
    return whole.unionByName(long).withColumn("value", F.regexp_replace("value", "\r$", ""))
