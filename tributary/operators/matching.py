"""Schema matching: which target field does a source column feed?

Headers repeat across files, so each distinct header is scored once and joined back.
The spellings of the declared schema travel with the expression as a literal array:
scoring is a projection, without a join and without a shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.similarity import (
    as_score,
    bind,
    common_with,
    sorted_tokens,
    thousandths,
)
from ..functions.text import literal_lookup, norm_header, quoted
from ..schema import TargetSchema
from ..session import stage

CANDIDATES = "array<struct<field:string,score:int>>"


def per_mille(x: float) -> int:
    return round(x * 1000)


def alias_field(header: Column, schema: TargetSchema) -> Column:
    """Field whose name or alias equals the header after normalization, else null."""
    return literal_lookup(list(schema.alias_owner().items()), norm_header(header))


def surface_array(pairs: list[tuple[str, str]]) -> Column:
    listed = ", ".join(
        f"struct({i} AS ord, {quoted(surface)} AS surface, {quoted(' '.join(sorted(surface.split())))} AS text, "
        f"{quoted(owner)} AS field)"
        for i, (surface, owner) in enumerate(pairs)
    )
    return F.expr(f"array({listed})")


def ranked_surfaces(header: Column, pairs: list[tuple[str, str]], limit: int) -> Column:
    """Best ``limit`` spellings: array of struct(loss, ord, surface, field), best first."""

    common = common_with([" ".join(sorted(surface.split())) for surface, _ in pairs])
    text = sorted_tokens(header)
    scored = bind(
        F.struct(F.length(text).alias("size"), common(text).alias("common")),
        lambda h: F.transform(
            surface_array(pairs),
            lambda s: F.struct(
                (-thousandths(F.get(h["common"], s["ord"]), h["size"] + F.length(s["text"]))).alias("loss"),
                s["ord"].alias("ord"),
                s["surface"].alias("surface"),
                s["field"].alias("field"),
            ),
        ),
    )
    return F.slice(F.array_sort(scored), 1, limit)


def best_per_field(ranked: Column, limit: int) -> Column:
    """Keep each field's best spelling, then the best ``limit`` fields."""
    firsts = F.filter(
        ranked,
        lambda x, i: F.array_position(F.transform(ranked, lambda y: y["field"]), x["field"]) == i + 1,
    )
    return F.transform(
        F.slice(firsts, 1, limit),
        lambda x: F.struct(x["field"].alias("field"), (-x["loss"]).alias("score")),
    )


def score_headers(headers: DataFrame, schema: TargetSchema, settings: Settings = DEFAULT) -> DataFrame:
    """Distinct headers with their alias hit and, without one, their candidates.

    Few bytes and much work per row: the distinct headers are spread over all cores,
    and the scores are stored because the rules and the adjudicator both read them.
    """
    pairs = schema.surfaces()
    scored = (
        headers.select("header")
        .distinct()
        .repartition(2 * headers.sparkSession.sparkContext.defaultParallelism, "header")
        .withColumn("alias_field", alias_field(F.col("header"), schema))
        .withColumn(
            "ranked",
            F.when(
                F.col("alias_field").isNull(),
                ranked_surfaces(F.col("header"), pairs, settings.top_surfaces),
            ),
        )
        .withColumn(
            "candidates",
            F.coalesce(
                bind(F.col("ranked"), lambda r: best_per_field(r, settings.top_fields)),
                F.array().cast(CANDIDATES),
            ),
        )
    )
    return stage(scored, "headers")


def tied_fields(candidates: Column, settings: Settings = DEFAULT) -> Column:
    """Fields whose score is within the delta of the best one."""
    delta = per_mille(settings.ambiguous_delta)
    return F.transform(
        F.filter(candidates, lambda x: candidates[0]["score"] - x["score"] <= delta),
        lambda x: x["field"],
    )


def decide(scored: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Add decision, target_field, method, confidence (thousandths), low_confidence."""
    c = F.col("candidates")
    top, second = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    best = F.coalesce(top["score"], F.lit(0))
    by_alias = F.col("alias_field").isNotNull()
    tie = second.isNotNull() & (
        best - second["score"] <= per_mille(settings.ambiguous_delta)
    )
    auto = best >= per_mille(settings.auto_apply)
    usable = best >= per_mille(settings.min_map)
    return scored.select(
        "*",
        F.when(by_alias, "auto_apply")
        .when(F.size(c) == 0, "unmapped_column")
        .when(tie, "ambiguous_mapping")
        .when(usable, "auto_apply")
        .otherwise("unmapped_column")
        .alias("decision"),
        F.when(by_alias, F.col("alias_field"))
        .when(~tie | second.isNull(), F.when(usable, top["field"]))
        .alias("target_field"),
        F.when(by_alias, "alias").otherwise("fuzzy").alias("method"),
        F.when(by_alias, F.lit(1000)).otherwise(best).alias("confidence"),
        (~by_alias & ~F.coalesce(tie, F.lit(False)) & usable & ~auto).alias("low_confidence"),
    )


Adjudicator = Callable[[DataFrame], DataFrame]


def closest_name(schema: TargetSchema) -> Adjudicator:
    """Default adjudicator: the closest field name among the options.

    An adjudicator maps (file, header, samples, options) to (file, header, suggested, suggested_score).
    One that calls an external service would do so in ``mapInPandas``; it only ever sees the columns
    that the rules left open. This one looks at headers alone, each of them once.
    """
    own = [(f.name, f.name) for f in schema]

    def run(open_headers: DataFrame) -> DataFrame:
        ranked = ranked_surfaces(F.col("header"), own, len(own))
        first = F.get(F.filter(ranked, lambda x: F.array_contains(F.col("options"), x["field"])), F.lit(0))
        best = open_headers.select("header", "options").distinct().withColumn("_best", first).select(
            "header",
            F.col("_best.field").alias("suggested"),
            (-F.col("_best.loss")).alias("suggested_score"),
        )
        return open_headers.select(*[c for c in ("file", "header") if c in open_headers.columns]).join(best, "header")

    return run


def options_for_review(decided: DataFrame, schema: TargetSchema, settings: Settings = DEFAULT) -> DataFrame:
    """Undecided headers with the fields the adjudicator may choose from."""
    every = F.array(*[F.lit(n) for n in schema.names])
    return decided.where(F.col("decision") != "auto_apply").select(
        "header",
        "decision",
        F.when(
            F.col("decision") == "ambiguous_mapping", tied_fields(F.col("candidates"), settings)
        )
        .otherwise(every)
        .alias("options"),
    )


def match_columns(
    catalog: DataFrame,
    schema: TargetSchema,
    settings: Settings = DEFAULT,
    adjudicate: Adjudicator | None = None,
    samples: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Mapping table: one row per (file, header) of the column catalog with the final decision.

    ``samples`` maps open columns (file, header) to (file, header, samples).
    """
    decided = decide(score_headers(catalog, schema, settings), settings)
    review = catalog.select("file", "header").join(options_for_review(decided, schema, settings), "header")
    none = F.array().cast("array<string>")
    if samples is not None:
        review = stage(review, "review")
        shown = stage(samples(review.select("file", "header")), "samples")
        review = review.join(shown, ["file", "header"], "left").withColumn("samples", F.coalesce("samples", none))
    else:
        review = review.withColumn("samples", none)
    # An answer counts if it is one of the options; of several answers, the best.
    answers = (
        (adjudicate or closest_name(schema))(review)
        .groupBy("file", "header").agg(F.max_by(F.struct("suggested", "suggested_score"), F.struct("suggested_score", "suggested")).alias("a"))
    )
    judged = review.join(answers, ["file", "header"], "left").select(
        "file", "header", "samples", F.when(F.array_contains("options", F.col("a.suggested")), F.col("a")).alias("a")
    ).select("file", "header", "samples", "a.*")
    ok = F.col("suggested").isNotNull() & (
        F.col("suggested_score") >= per_mille(settings.auto_apply)
    )
    auto = F.col("decision") == "auto_apply"
    unmapped = F.col("decision") == "unmapped_column"
    dropped = unmapped & F.lit(schema.unmapped_policy == "drop")
    return catalog.join(decided, "header").join(judged, ["file", "header"], "left").select(
        *catalog.columns,
        "decision",
        F.when(auto, F.col("target_field")).when(ok, F.col("suggested")).alias("target_field"),
        F.when(auto, F.col("method")).when(ok | unmapped, "llm").otherwise("fuzzy").alias("method"),
        as_score(
            F.when(auto, F.col("confidence"))
            .when(ok | unmapped, F.coalesce(F.col("suggested_score"), F.lit(0)))
            .otherwise(F.col("confidence"))
        ).alias("confidence"),
        F.when(auto | ok, "auto_applied").when(dropped, "rejected").otherwise("escalated").alias("status"),
        F.when(auto & (F.col("method") == "alias"), "exact alias match")
        .when(auto & F.col("low_confidence"), "fuzzy match, low confidence")
        .when(auto, "fuzzy match")
        .when(ok & unmapped, "adjudicated")
        .when(ok, "adjudicated tie")
        .when(unmapped, "best score below the minimum")
        .otherwise("top candidates too close")
        .alias("rationale"),
        F.col("confidence").alias("match_confidence"),
        "candidates",
        "low_confidence",
        F.coalesce("samples", none).alias("samples"),
    )


def unmapped_report(mappings: DataFrame) -> DataFrame:
    """Columns that wait for a decision, with what a person needs to see."""
    return mappings.where(F.col("status") == "escalated").select(
        "file", "header", F.col("decision").alias("type"), as_score(F.col("match_confidence")).alias("confidence"), "samples")


def field_columns(
    pairs: list[tuple[str, str]], schema: TargetSchema, columns: list[str]
) -> list[Column]:
    """Target fields out of the source columns of one file.

    ``pairs`` are (source column, target field) in column order. Where two columns
    feed one field, the last one that is not null wins.
    """
    feeds: dict[str, list[str]] = {}
    for source, target in pairs:
        if source in columns:
            feeds.setdefault(target, []).append(source)
    out = []
    for name in schema.names:
        sources = [F.col(f"`{c}`") for c in reversed(feeds.get(name, []))]
        out.append((F.coalesce(*sources) if sources else F.lit(None).cast("string")).alias(name))
    return out
