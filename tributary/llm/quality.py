"""Quality rules with thresholds taken from quantile sketches of each language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACES, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SALTS = 8


@dataclass(frozen=True)
class QualityRules:
    """`fence`: how many interquartile ranges beyond the upper quartile are still normal.

    `slack` is the least distance from the quartile in thousandths, so that a group
    whose texts are all alike doesn't reject the first that differs. Groups of fewer
    than `least` texts use the merged sketch of their language, then that of the corpus.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    fence: int = 3
    slack: int = 100
    least: int = 100


def _symbols(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))


def _windows(words: Column) -> Column:
    """64-bit hashes of the windows of 8 words, null for shorter texts."""
    n = F.size(words)
    return F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    )


def measures(text: Column) -> dict[str, Column]:
    """Columns of the fixed measures of a text; see `measure` for the repeated words."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    return {
        "_words": words,
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": _symbols(text).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _settled(value: Column) -> Column:
    """The value as the one row of a generator.

    Filters above are not moved below a generator, nor is its input copied into the
    functions above, where it would be computed once for each element of an array.
    """
    return F.explode(F.array(value))


def measure(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """`docs` with the measures under names that start with _q_.

    Words in repeated windows: most texts have no equal windows, which a hash set
    tells. In the others, windows are sorted by (hash, place), and equal neighbours
    repeat. Taken by place, each adds the words that the one before did not cover.
    """
    m = measures(text_or_empty())
    docs = docs.withColumn("_q__words", _settled(m.pop("_words"))).withColumns({f"_q_{k}": c for k, c in m.items()})
    docs = docs.withColumn("_q_n_words", F.size("_q__words").cast("long"))
    if not repeats:
        return docs.drop("_q__words")
    docs = docs.withColumn("_q_hash", _settled(_windows(F.col("_q__words"))))
    hashes = F.col("_q_hash")
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn(
        "_q_sorted", _settled(F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed))
    ).drop("_q_hash", "_q__words")
    s = F.col("_q_sorted")
    places = F.array_sort(
        F.transform(
            F.filter(
                s,
                lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])),
            ),
            lambda x: x["i"],
        )
    )
    docs = docs.withColumn("_q_places", _settled(places)).drop("_q_sorted")
    p = F.col("_q_places")
    new = F.transform(p, lambda at, j: F.coalesce(F.least(F.lit(WINDOW), at - F.get(p, j - 1)), F.lit(WINDOW)))
    total = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn("_q_n_repeat_words", _settled(F.coalesce(total, F.lit(0).cast("long")))).drop("_q_places")


def features() -> dict[str, Column]:
    """Whole thousandths, so that sums and thresholds are the same in any order."""
    n, chars = F.col("_q_n_words"), F.col("_q_word_chars")
    per = lambda part, whole: F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("long")
    return {
        "symbols": per(F.col("_q_n_symbols"), chars),
        "lines": per(F.col("_q_n_dup_lines"), n),
        "length": per(chars, n),
    }


def bucket(v: Column) -> Column:
    """Lower end of the sketch's bucket of a whole number: its 7 leading bits.

    A count per bucket is a quantile sketch with a relative error below 1/64 at any
    rank. Sketches merge by adding counts, so they don't depend on partitions or order.
    """
    bits = F.greatest(F.char_length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, bits), bits)


def sketches(docs: DataFrame) -> DataFrame:
    """(lang, source, feature, value, n): one quantile sketch per language, source and feature."""
    named = [F.struct(F.lit(k).alias("feature"), bucket(c).alias("value")) for k, c in features().items()]
    return (
        measure(docs.select("text", "lang", "source"), repeats=False)
        .where(F.col("_q_n_words") > 0)
        .select("lang", "source", F.inline(F.array(*named)))
        .groupBy("lang", "source", "feature", "value")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Group size and quartiles: the first bucket whose running count reaches a rank."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by, "feature")
    merged = sketch.groupBy(*by, "feature", "value").agg(F.sum("n").alias("n"))
    ranked = merged.select(
        *by, "feature", "value", F.sum("n").over(w.orderBy("value")).alias("below"), F.sum("n").over(w).alias("size")
    )
    first = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("size") * q, F.col("value")))
    return ranked.groupBy(*by, "feature").agg(
        F.max("size").alias("size"), first(1).alias("q1"), first(3).alias("q3")
    )


def thresholds(sketch: DataFrame, rules: QualityRules) -> DataFrame:
    """(lang, source, low, high of each feature): quartiles widened by the fence.

    The sketches of a small group are merged upwards until there are enough texts.
    """
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("feature").alias("l_feature"),
        *[F.col(c).alias(f"l_{c}") for c in ("size", "q1", "q3")],
    )
    whole = _quartiles(sketch, []).select(
        F.col("feature").alias("w_feature"), *[F.col(c).alias(f"w_{c}") for c in ("q1", "q3")]
    )
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("feature") == F.col("l_feature"))).join(
        whole, F.col("feature") == F.col("w_feature")
    )
    pick = lambda c: F.when(F.col("size") >= rules.least, F.col(c)).when(
        F.col("l_size") >= rules.least, F.col(f"l_{c}")
    ).otherwise(F.col(f"w_{c}"))
    q1, q3 = pick("q1"), pick("q3")
    # A text is also normal within half of the quartile's own size.
    far = F.greatest((q3 - q1) * rules.fence, F.lit(rules.slack), F.floor(q3 / 2))
    wide = joined.select("lang", "source", "feature", (q1 - far).alias("low"), (q3 + far).alias("high"))
    return wide.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("feature") == k, F.col("high"))).alias(f"_t_{k}_high") for k in features()],
        F.max(F.when(F.col("feature") == "length", F.col("low"))).alias("_t_length_low"),
    )


def apply_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Every row of `docs` with its measures, `base_failed` and `kept`.

    A text fails at once with fewer than `min_words` words or with more than
    `max_repeat_percent` of its words inside repeated windows. Of the others, those
    are kept whose share of symbols, of repeated lines and whose mean word length lie
    within the thresholds of their language and source. Null texts count as empty, so
    they fail. Null languages and sources are groups of their own. Columns of the input
    stay as they are, except that columns named like a measure are replaced.

    A third of the rows may be of one source: thresholds are repeated under 8 salts.
    """
    limits = stage(thresholds(sketches(docs), rules), "limits").select(
        F.col("lang").alias("_t_lang"), F.col("source").alias("_t_source"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_t_salt"), "*",
    ).drop("lang", "source")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = docs.drop(*[c for c in (*names, "base_failed", "kept") if c in docs.columns])
    measured = measure(docs).withColumn("_q_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    joined = measured.join(
        limits,
        F.col("lang").eqNullSafe(F.col("_t_lang"))
        & F.col("source").eqNullSafe(F.col("_t_source"))
        & (F.col("_q_salt") == F.col("_t_salt")),
        "left",
    )
    n, f = F.col("_q_n_words"), features()
    failed = (n < rules.min_words) | (F.col("_q_n_repeat_words") * 100 > n * rules.max_repeat_percent)
    normal = (
        (f["symbols"] <= F.col("_t_symbols_high"))
        & (f["lines"] <= F.col("_t_lines_high"))
        & (f["length"] <= F.col("_t_length_high"))
        & (f["length"] >= F.col("_t_length_low"))
    )
    out = joined.select(
        *[F.col(c) for c in docs.columns],
        *[F.col(f"_q_{c}").alias(c) for c in names],
        failed.alias("base_failed"),
        (~failed & F.coalesce(normal, F.lit(False))).alias("kept"),
    )
    return out
