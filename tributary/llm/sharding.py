"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .common import text_or_empty

OVERHEAD = 16
# Parts of a shard that are numbered apart: a task sorts 1/256 of a shard.
PARTS = 256


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone."""
    h = F.call_function("shiftrightunsigned", F.xxhash64(key, F.lit(shard)), F.lit(11))
    return (h.cast("double") + 0.5) / float(1 << 53)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score for the key; ties go to the lower number.

    The score -w / ln(draw) gives each shard its share of the weights. A shard more takes
    exactly those keys for which its score is the highest; no key moves between others.
    """
    scores = [
        F.struct((-F.lit(float(w)) / F.log(draw(key, s))).alias("score"), F.lit(-s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    return (-F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)).cast("int")


def assign_shards(
    docs: DataFrame, key: Column, weights: list[float], grown: list[float] | None = None
) -> DataFrame:
    """`docs` with `shard` and, where weights of a grown set are given, `grown_shard`.

    Null keys are one key like any other. A projection: no row moves, so a frequent
    key costs nothing here. Columns of these names are replaced.
    """
    docs = docs.withColumn("shard", rendezvous(key, weights))
    if grown is None:
        return docs
    return docs.withColumn("grown_shard", rendezvous(key, grown))


def number_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add `slot`, from 0 without gaps within each shard.

    A shard may be large, so it is cut into parts by a hash of `order`; the parts are
    counted, their counts summed before them, and rows numbered within a part. The
    table of counts has at most shards x 256 rows. Rows equal in all of `order` may
    swap their slots; they can't be told apart.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("_part", part)
    before = W.partitionBy(shard).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(shard, "_part")
        .agg(F.count("*").alias("_n"))
        .select(
            F.col(shard).alias("_s_shard"), F.col("_part").alias("_s_part"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        )
    )
    inside = F.row_number().over(W.partitionBy(shard, "_part").orderBy(*order)) - 1
    numbered = rows.withColumn("_inside", inside)
    return (
        numbered.join(
            F.broadcast(starts),  # at most shards x PARTS rows
            (F.col(shard) == F.col("_s_shard")) & (F.col("_part") == F.col("_s_part")),
        )
        .withColumn("slot", (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_part", "_inside", "_s_shard", "_s_part", "_start")
    )


def place(docs: DataFrame, shards: int) -> DataFrame:
    """One row per row of `docs`: size, checksum, shard, slot and the shard with one more.

    Null texts are empty. Equal texts are numbered apart, since shards follow the key.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = assign_shards(rows, F.col("doc_id"), [1.0] * shards, [1.0] * (shards + 1))
    return number_slots(stage(rows, "shards"), "shard", ["doc_id", "text_crc32", "size"])


def write_shards(docs: DataFrame, key: Column, weights: list[float], path: str) -> None:
    """Write `docs` as Parquet with one folder per shard, without a shuffle."""
    assign_shards(docs, key, weights).write.partitionBy("shard").parquet(path)
