"""Token weights raked to source, language and topic marginals, and sampling by them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import text_or_empty

AXES = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mixture:
    """Targets.

    `shares`: wanted share of the tokens for values of an axis. Values without one get
    what is left, in proportion to their tokens to the power `temper`, which lifts rare
    values. `budget`: tokens to take, repeats included, as a share of all.
    """

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: float = 0.8
    budget: float = 0.7
    sweeps: int = 12
    tolerance: float = 1e-3
    seed: int = 17


def topic(size: Column, marks: Column) -> Column:
    """A coarse topic by form, where documents carry none.

    `size` is the text's length, `marks` its characters other than letters, spaces and
    the commonest punctuation.
    """
    count = lambda chars: F.char_length(marks) - F.char_length(F.translate(marks, chars, ""))
    share = lambda chars: count(chars) / F.greatest(size, F.lit(1))
    return (
        F.when(share("|") > 0.03, "table")
        .when(share("{}[]()<>=;#$%&*_\\/") > 0.05, "markup")
        .when(share("0123456789") > 0.1, "figures")
        .when(share("!?") > 0.03, "exclaimed")
        .when(size < 500, "note")
        .otherwise("prose")
    )


def _labelled(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    axes = {f"_m_{a}": F.coalesce(F.col(a).cast("string"), F.lit("")) for a in AXES if a in docs.columns}
    docs = docs.withColumns(axes | {"_m_tokens": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")})
    if "topic" in docs.columns:
        return docs
    # A generator's row, so that the text is searched once and not for each use.
    docs = docs.withColumn("_m_marks", F.explode(F.array(F.regexp_replace(text, "[\\p{L}\\s.,'-]+", ""))))
    return docs.withColumn("_m_topic", topic(F.char_length(text), F.col("_m_marks"))).drop("_m_marks")


def targets(cells: DataFrame, axis: str, mix: Mixture, *more: Column) -> DataFrame:
    """(value of the axis, share): shares given, the rest tempered; they add to 1.

    `more` are further sums over a value's cells, as columns between the two.
    """
    a = f"_m_{axis}"
    sums = cells.groupBy(a).agg(F.sum("n").alias("n"), *more)
    given = mix.shares.get(axis, {})
    known = F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))]) if given else None
    fixed = F.element_at(known, F.col(a)) if given else F.lit(None).cast("double")
    lift = F.when(fixed.isNull(), F.pow(F.col("n"), F.lit(mix.temper))).otherwise(0.0)
    total = sums.agg(F.sum(lift).alias("rest"), F.sum(F.coalesce(fixed, F.lit(0.0))).alias("given")).first()
    rest, named = total["rest"] or 0.0, total["given"] or 0.0
    # Where all values are given, or more than everything, shares are scaled to add to 1.
    scale = named if named > 1 or not rest else 1.0
    left = max(0.0, 1 - named) / rest if rest else 0.0
    share = F.coalesce(fixed, lift * left) / max(scale, 1e-12)
    return sums.withColumn("share", share).drop("n")


def rake(cells: DataFrame, mix: Mixture) -> DataFrame:
    """Cells with `ratio`: by how much the tokens of each have to be weighted.

    Iterative proportional fitting: each step scales the cells of a value so that their
    weighted tokens meet the value's share; a sweep does so for source, language and
    topic. It ends when no marginal misses its share by more than `tolerance` of it. Sums
    are grouped before they are joined back, so a frequent value is a few cells, not rows.
    Cells carry the shares and are staged after each step. A step planned on top of another
    holds it twice, in its sums and in its cells, so plans, and what the driver broadcasts for
    them, would double from axis to axis.
    """
    n = cells.agg(F.sum("n")).first()[0] or 0
    current = cells.withColumn("ratio", F.lit(1.0 / max(n, 1)))
    for a in AXES:
        current = current.join(targets(cells, a, mix).withColumnRenamed("share", f"_share_{a}"), f"_m_{a}", "left")
    current = stage(current.withColumn("_miss", F.lit(0.0)).coalesce(8), "cells")
    for _ in range(mix.sweeps):
        for a in AXES:
            sums = current.groupBy(f"_m_{a}").agg(
                F.sum(F.col("n") * F.col("ratio")).alias("_sum"), F.max(f"_share_{a}").alias("share")
            )
            factor = sums.select(
                f"_m_{a}", F.when(F.col("_sum") > 0, F.col("share") / F.col("_sum")).otherwise(0.0).alias("_by")
            )
            off = F.abs(F.col("_by") - 1)
            scaled = current.join(factor, f"_m_{a}").withColumns({
                "ratio": F.col("ratio") * F.col("_by"), "_miss": off if a == AXES[0] else F.greatest("_miss", off)
            })
            current = stage(scaled.drop("_by").coalesce(8), "cells")
        worst = current.where((F.col("n") > 0) & (F.col("ratio") > 0)).agg(F.max("_miss")).first()[0]
        if worst is None or worst <= mix.tolerance:
            break
    return current.drop("_miss", *[f"_share_{a}" for a in AXES])


def calibrate(cells: DataFrame, mix: Mixture) -> DataFrame:
    """Cells with `p`, the expected copies of their documents: the ratio times one factor.

    The factor makes the expected tokens meet the budget and is the same for all cells, so
    the raked shares are those that are sampled. Rare cells may need more than they
    have: a p above 1 stands for repeats.
    """
    total, weighed = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("ratio"))).first()
    factor = mix.budget * (total or 0) / weighed if weighed else 0.0
    return cells.withColumn("p", F.round(F.col("ratio") * factor, 9))


def marginals(cells: DataFrame, mix: Mixture) -> DataFrame:
    """axis, value, share wanted, share expected from `p`, and what is unmet, for every marginal.

    Targets that contradict each other, such as those of a source and of a language that
    only occur together, cannot all be met by any weights.
    """
    total = cells.agg(F.sum(F.col("n") * F.col("p"))).first()[0] or 0.0
    each = []
    for a in AXES:
        expected = F.col("_sum") / total if total else F.lit(0.0)
        each.append(
            targets(cells, a, mix, F.sum(F.col("n") * F.col("p")).alias("_sum")).select(
                F.lit(a).alias("axis"), F.col(f"_m_{a}").alias("value"), F.col("share").alias("wanted"), expected.alias("expected")
            ).where(F.col("value").isNotNull())
        )
    return reduce(DataFrame.unionByName, each).withColumn("unmet", F.col("wanted") - F.col("expected"))


def report(cells: DataFrame, mix: Mixture, most: int = 20) -> None:
    """Warns of the marginals that miss their share by more than `tolerance` of it."""
    missed = marginals(cells, mix).where(F.abs("unmet") > F.col("wanted") * mix.tolerance)
    worst = missed.orderBy(F.abs("unmet").desc(), "axis", "value").limit(most).collect()
    if worst:
        listed = ", ".join(f"{r.axis} {r.value!r} {r.expected:.4g} for {r.wanted:.4g}" for r in worst)
        warnings.warn(f"shares that are not met: {listed}", stacklevel=3)


def draw(seed: int) -> Column:
    """A number in [0, 1) that depends on the document's id and text alone."""
    h = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(11))
    return h.cast("double") / float(1 << 53)


def mix_sources(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """Every row of `docs` with topic, tokens, `p`, `copies` and `sampled`.

    Documents of a cell (source, language, topic) are taken independently, p times on average:
    as often as p is whole, and once more with the chance of the rest. Equal rows share
    their fate. Null sources and languages are the value "". Texts without tokens weigh
    nothing and are taken with the chance of their cell, once at most. The tables of cells
    and chances grow with the number of sources, not of documents; documents join them
    under 8 salts, since a third may be of one source.
    """
    labelled = _labelled(docs)
    axes = [f"_m_{a}" for a in AXES]
    cells = stage(labelled.groupBy(*axes).agg(F.sum("_m_tokens").alias("n")), "cells")
    chances = stage(calibrate(rake(cells, mix), mix).select(*axes, "n", "p"), "chances")
    report(chances, mix)
    salted = chances.drop("n").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_m_salt"))
    rows = labelled.withColumn("_m_salt", F.pmod(F.xxhash64("text"), F.lit(8)).cast("int"))
    joined = rows.join(salted.withColumnRenamed("p", "_m_p"), [*axes, "_m_salt"])
    whole = F.floor("_m_p")
    copies = whole + (draw(mix.seed) < F.col("_m_p") - whole).cast("long")
    joined = joined.withColumn("_m_copies", F.when(F.col("_m_tokens") > 0, copies).otherwise(F.least(copies, F.lit(1))))
    others = [c for c in docs.columns if c not in ("topic", "tokens", "p", "copies", "sampled")]
    return joined.select(
        *others, F.col("_m_topic").alias("topic"), F.col("_m_tokens").alias("tokens"), F.col("_m_p").alias("p"),
        F.col("_m_copies").cast("long").alias("copies"), (F.col("_m_copies") > 0).alias("sampled"),
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of every row of `mixed`, as often as its copies."""
    taken = mixed.where("sampled").withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*columns)
