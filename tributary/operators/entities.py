"""Entity resolution: rows that share any match key describe one entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits, not_blank, strip
from ..schema import TargetSchema
from ..session import stage


def key_of(name: str, value: Column, schema: TargetSchema) -> Column:
    """Match key of one value, null when there is nothing to match on.

    The primary key compares by its digits; without a digit it is no key at all.
    """
    if name == schema.primary_key:
        d = digits(value)
        return F.when(not_blank(value) & (d != ""), F.concat(F.lit("id:"), d))
    return F.when(not_blank(value), F.concat(F.lit(f"{name}:"), F.lower(strip(value))))


def key_columns(schema: TargetSchema) -> list[Column]:
    """The match keys of a row in schema order, null where there is none."""
    return [key_of(k, F.col(k), schema) for k in schema.match_keys if schema.has(k)]


def match_keys(schema: TargetSchema) -> Column:
    """All match keys of a row, in schema order."""
    return F.array_compact(F.array(*key_columns(schema)))


def first_key(schema: TargetSchema) -> Column:
    return F.coalesce(*key_columns(schema), F.lit(None).cast("string"))


def unmatched_id() -> Column:
    return F.concat_ws(":", F.lit("unmatched"), F.col("file"), F.col("row_idx").cast("string"))


def key_edges(rows: DataFrame, schema: TargetSchema) -> DataFrame:
    """Distinct pairs (hi, lo) of keys that occur together in a row.

    Linking the first key to each other key is enough: one row of n keys gives
    n - 1 pairs, never all pairs.
    """
    n = len(key_columns(schema))
    keys = [F.col(f"key_{i}") for i in range(n)]
    # Columns and not a list of keys: Spark would work out a list again for each filter on it.
    return (
        rows.select(*[c.alias(f"key_{i}") for i, c in enumerate(key_columns(schema))])
        .select(F.coalesce(*keys, F.lit(None)).alias("a"), F.explode_outer(F.array(*keys[1:]).cast("array<string>")).alias("b"))
        .where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """True when every node is either a root or has exactly one edge, to its root."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    mixed = (
        ends.groupBy("node")
        .agg(F.sum("up").alias("ups"), F.max("down").alias("root"))
        .where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("root") > 0)))
    )
    return mixed.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    around = edges.select(F.col("hi").alias("node"), F.col("lo").alias("next")).union(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("next"))
    )
    least = around.groupBy("node").agg(F.min("next").alias("m")).select(
        "node", F.least("node", "m").alias("m")
    )
    return (
        around.where(F.col("next") > F.col("node")).join(least, "node")
        .select(F.col("next").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    lower = (
        edges.join(least, "hi")
        .where(F.col("lo") != F.col("m"))
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    )
    return lower.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(key, root) for every key that is not itself the smallest of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014) bring any
    graph to stars in a number of rounds that grows with the logarithm of its size.
    Each round is a grouped minimum with map-side combining and a join to it, whose hot
    partitions Spark splits at run time, and is written to the shared folder.
    """
    current = stage(edges, "edges")
    while not _is_star_forest(current):
        larger = stage(_large_star(current), "edges")
        current = stage(_small_star(larger), "edges")
    return current.select(F.col("hi").alias("key"), F.col("lo").alias("root"))


def extend_components(edges: DataFrame, roots_of: Callable[[DataFrame], DataFrame], members_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, root) of every key whose root is new or another when ``edges`` come to components that are stored.

    ``roots_of`` looks up (key, root) for (key); ``members_of`` looks up (root, key) for (root). The new edges
    are drawn between the roots of their ends, so rounds run over edges as many as came, and only the members
    of components that got another root are read and told anew.
    """
    ends = edges.select(F.col("hi").alias("key")).union(edges.select(F.col("lo").alias("key"))).distinct()
    known = stage(roots_of(ends), "roots")
    side = {n: known.select(F.col("key").alias(n), F.col("root").alias(f"{n}_root")) for n in ("hi", "lo")}
    placed = edges.join(side["hi"], "hi", "left").join(side["lo"], "lo", "left").select(
        F.coalesce("hi_root", "hi").alias("a"), F.coalesce("lo_root", "lo").alias("b"))
    between = placed.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    moved = stage(connected_components(between), "moved")
    members = members_of(moved.select(F.col("key").alias("root"))).join(
        moved.select(F.col("key").alias("root"), F.col("root").alias("new")), "root").select("key", F.col("new").alias("root"))
    return moved.union(members).groupBy("key").agg(F.min("root").alias("root"))


def link_rows(rows: DataFrame, schema: TargetSchema, roots: DataFrame | None = None) -> DataFrame:
    """Add ``entity_id``: the smallest key of the row's component.

    Rows without a key form an entity of their own. ``roots`` are components known already.
    """
    if roots is None:
        roots = connected_components(key_edges(rows, schema))
    keyed = rows.withColumn("key", first_key(schema))
    joined = keyed.join(roots, "key", "left")
    return joined.withColumn(
        "entity_id", F.coalesce("root", "key", unmatched_id())
    ).drop("root", "key")


def natural_key(schema: TargetSchema, entity_id: Column | None = None) -> Column:
    """First match key of the merged record, else the id of the unmatched row."""
    return F.coalesce(*key_columns(schema), F.col("entity_id") if entity_id is None else entity_id)


def entity_keys(linked: DataFrame, schema: TargetSchema, wanted: DataFrame | None = None) -> DataFrame:
    """(key, entity_id) for every key and every row fingerprint of linked rows.

    With ``wanted``, only for the keys it names: the few that decisions mention.

    A key stays with its entity when a later mapping adds more keys, so decisions
    stored by key find their entity again after a rebuild.
    """
    fingerprints = linked.select(unmatched_id().alias("key"), "entity_id")
    # All rows of a key are in its entity, so a key that many rows share travels once.
    keys = F.explode_outer(F.array(*key_columns(schema)).cast("array<string>"))
    named = linked.select(keys.alias("key"), "entity_id").where(F.col("key").isNotNull()).distinct()
    if wanted is not None:
        # Few decisions name a row by its fingerprint, and stored they say how few: the rows need not travel for them.
        asked = stage(wanted.select("key").where(F.col("key").isNotNull()).distinct(), "wanted")
        marks = stage(asked.where(F.col("key").startswith("unmatched:")), "wanted")
        named, fingerprints = named.join(asked, "key", "left_semi"), fingerprints.join(marks, "key", "left_semi")
    return named.union(fingerprints).distinct()


def duplicate_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of rows of one file that agree in every column."""
    return (
        rows.groupBy("file", *columns)
        .agg(F.count("*").alias("copies"), F.min("row_idx").alias("first_row"))
        .where(F.col("copies") > 1)
    )
