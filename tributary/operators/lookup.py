"""Resolve free-text references against the keys a run already knows.

Exact best matches without comparing every value with every key: distinct values and distinct
keys are cut into blocks by their order. A unit of work is one block of values against the
trie of one block of keys, which drops a value at the nodes below which nothing can reach what it
has found already. Units hand on only the best few matches per value. No pair is ever written out and
no side is held whole anywhere.
"""

from __future__ import annotations

import pickle
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.similarity import as_score, sorted_tokens
from ..functions.text import not_blank
from ..schema import TargetSchema
from ..session import stage
from .keytrie import KeyTrie
from .matching import per_mille

# Keys of a block, and letters they have in about.
KEY_BLOCK, LETTERS = 65_536, 1 << 21
# Values of a block: at least, where they are few, and at most, in about.
VALUE_BLOCK, MANY_VALUES = 512, 65_536
# One key in so many is looked at first, where there are several blocks of keys.
BEAM = 32
# Units of work for each core: they differ much, as some blocks of keys hold nearly all that a value is like.
UNITS = 16
# Ways that a value goes at once in the passes that only find out what a match must reach.
WAYS = 32
MAX_TASKS = 20_000


def known_keys(records: DataFrame, field: str) -> DataFrame:
    return records.where(F.coalesce(F.col(field) != "", F.lit(False))).select(F.col(field).alias("key")).distinct()


def is_unresolved(field: str) -> Column:
    """A reference that is filled but is not an address."""
    return not_blank(F.col(field)) & ~F.col(field).contains("@")


def unresolved_values(records: DataFrame, field: str) -> DataFrame:
    return records.where(is_unresolved(field)).select(F.col(field).alias("value")).distinct()


TRIE, FOUND = "keys_block long, trie binary", "value string, key string, score long, home long"


def _build_block(keys: pd.DataFrame) -> pd.DataFrame:
    """The trie of a block of keys, made once, as bytes; with the names and the home of each of its texts."""
    names, home = dict(zip(keys["text"], keys["names"])), dict(zip(keys["text"], keys["home"].tolist()))
    trie = KeyTrie(list(names))
    own = [list(names[t]) for t in trie.texts]
    # Of texts that score the same, those with the first names go first: theirs are the names that count.
    order = np.empty(len(own), np.int64)
    order[sorted(range(len(own)), key=lambda i: own[i][0])] = np.arange(len(own))
    packed = pickle.dumps((trie.state(), own, [home[t] for t in trie.texts], order), protocol=5)
    return pd.DataFrame({"keys_block": keys["keys_block"].iloc[:1], "trie": [packed]})


def _match_block(limit: int, ways: int | None):
    """Best matches of a block of values in a block of keys; a row without a value says how many pairs were scored."""

    def run(values: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[str | None, str | None, int, int | None]] = []
        if len(values) and len(tries):
            state, names, home, order = pickle.loads(tries["trie"].iloc[0])
            value, place, score, seen = KeyTrie.of(state).search(
                values["text"].tolist(), values["least"].to_numpy(np.int64), limit, order, ways)
            own = values["value"].tolist()
            rows = [(own[v], name, n, home[p]) for v, p, n in zip(value.tolist(), place.tolist(), score.tolist()) for name in names[p]]
            rows.append((None, None, seen, None))
        return pd.DataFrame(rows, columns=["value", "key", "score", "home"]).astype({"home": "Int64"})

    return run


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("value").orderBy(F.desc("score"), "key")
    return found.where("value IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


class Matches(NamedTuple):
    """``best``: (value, key, score, rank). ``compared``: pairs of value and key that were scored; bounds or too few common letters ruled out the rest."""

    best: DataFrame
    compared: int


def search_matches(values: DataFrame, keys: DataFrame, limit: int = DEFAULT.top_lookup) -> Matches:
    """The best ``limit`` keys of each distinct value, exact, with their words sorted.

    First passes only find out what a match must reach: a value goes the most promising ways down, among few of the
    keys and then among all in the blocks of the best of those. The last of the best it finds is what a match must
    reach in the last pass, over all keys, which so drops most nodes high up in the tries and misses none. Both sides of
    a unit of work travel as rows to its own task, the trie of a block in one: neither is broadcast, and a trie serves
    thousands of values.
    """
    spark = values.sparkSession
    backwards = lambda c: F.reverse(sorted_tokens(F.col(c)))  # noqa: E731 - addresses share their ends
    asked = stage(values.select(F.col(values.columns[0]).alias("value"), backwards(values.columns[0]).alias("text")), "lookup-values")
    same = Window.partitionBy("text").orderBy("key")
    texts = stage(
        keys.select(F.col(keys.columns[0]).alias("key"), backwards(keys.columns[0]).alias("text"))
        .withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= limit)
        .groupBy("text").agg(F.array_sort(F.collect_list("key")).alias("names")), "lookup-keys",
    )
    n_asked, n_texts = asked.count(), texts.count()
    n_letters = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = lambda n, size: max(1, -(-n // size))

    def dealt(df: DataFrame, n: int, block: str) -> DataFrame:
        # Neighbours in order share letters: a block of keys is a small trie, a block of values leaves most of it alone.
        return stage(df.repartitionByRange(n, "text").withColumn(block, F.spark_partition_id().cast("long")), "lookup-blocks")

    def search(least: DataFrame, tries: DataFrame, n_keys: int, ways: int | None, name: str, near: DataFrame | None = None) -> DataFrame:
        # Large blocks travel seldom; small ones keep all cores busy where there is little.
        wanted = max(n_asked // MANY_VALUES, -(-UNITS * spark.sparkContext.defaultParallelism // n_keys))
        n_values = min(blocks(n_asked, VALUE_BLOCK), max(1, wanted))
        left = dealt(least if near is None else least.join(near, "value"), n_values, "values_block")
        every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
        sides = [
            left if near is not None else left.withColumn("keys_block", every(n_keys)),
            tries.withColumn("values_block", every(n_values)),
        ]
        # More tasks than units, or hashing would put several into one task while others have none.
        units = min(MAX_TASKS, 4 * n_values * n_keys)
        one, other = (df.repartition(units, "values_block", "keys_block").groupBy("values_block", "keys_block") for df in sides)
        return stage(one.cogroup(other).applyInPandas(_match_block(limit, ways), FOUND), name)

    def reached(found: DataFrame) -> DataFrame:
        return _ranked(found, limit).where(F.col("rank") == limit).select("value", F.col("score").alias("reached"))

    def raised(least: DataFrame, found: DataFrame) -> DataFrame:
        more = least.join(reached(found), "value", "left")
        return more.withColumn("least", F.greatest("least", F.coalesce("reached", F.lit(0)))).drop("reached")

    def built(keys: DataFrame) -> DataFrame:
        return stage(keys.repartition(4 * n_keys, "keys_block").groupBy("keys_block").applyInPandas(_build_block, TRIE), "lookup-tries")

    n_keys = max(blocks(n_texts, KEY_BLOCK), blocks(n_letters, LETTERS))
    placed = dealt(texts, n_keys, "home")
    tries = built(placed.withColumn("keys_block", F.col("home")))
    least = asked.withColumn("least", F.lit(0).cast("long"))
    if n_keys == 1:
        passes = [search(least, tries, 1, WAYS, "matches")]
    else:
        some = placed.where(F.pmod(F.xxhash64("text"), F.lit(BEAM)) == 0)
        n_some = blocks(n_keys, BEAM)
        passes = [search(least, built(dealt(some, n_some, "keys_block")), n_some, WAYS, "matches")]
        near = _ranked(passes[0], limit).select("value", F.col("home").alias("keys_block")).distinct()
        least = raised(least, passes[0])
        passes.append(search(least, tries, n_keys, WAYS, "near-matches", near))
    found = search(raised(least, passes[-1]), tries, n_keys, None, "matches")
    compared = reduce(DataFrame.unionByName, [*passes, found]).where("value IS NULL").agg(F.sum("score")).first()[0] or 0
    return Matches(_ranked(found, limit).select("value", "key", F.col("score").cast("int").alias("score"), "rank"), compared)


def top_matches(values: DataFrame, keys: DataFrame, limit: int = DEFAULT.top_lookup) -> DataFrame:
    """(value, key, score, rank) with the best ``limit`` keys of each distinct value."""
    return search_matches(values, keys, limit).best


def resolve(
    records: DataFrame,
    matches: DataFrame,
    schema: TargetSchema,
    settings: Settings = DEFAULT,
    skip: Column | None = None,
) -> DataFrame:
    """Replace references whose best match reaches the threshold.

    Adds ``lookup_from`` (the replaced text) and ``lookup_open`` (still unresolved).
    """
    f = schema.lookup_field
    best = matches.where(F.col("rank") == 1).select(
        F.col("value").alias("_ref"), F.col("key").alias("_key"), F.col("score").alias("_score")
    )
    todo = is_unresolved(f) if skip is None else is_unresolved(f) & ~skip
    asked = records.withColumn("_ref", F.when(todo, F.col(f)))
    # Most records ask nothing: they don't take part in the join, where they would all meet at one null key.
    idle = asked.where(F.col("_ref").isNull()).withColumns({"_key": F.lit(None).cast("string"), "_score": F.lit(None).cast("int")})
    sure = F.col("_ref").isNotNull() & F.coalesce(
        F.col("_score") >= per_mille(settings.auto_apply), F.lit(False)
    )
    joined = asked.where(F.col("_ref").isNotNull()).join(best, "_ref", "left")
    return joined.unionByName(idle).select(
        *[
            F.when(sure, F.col("_key")).otherwise(F.col(f)).alias(f) if c == f else F.col(c)
            for c in records.columns
        ],
        F.when(sure, F.col(f)).alias("lookup_from"),
        (F.col("_ref").isNotNull() & ~sure).alias("lookup_open"),
    )


def option_rows(matches: DataFrame) -> DataFrame:
    return matches.select("value", "rank", "key", as_score(F.col("score")).alias("score"))
