"""Read queries and metrics over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses in the order they are shown.
FACET_ORDER = ["needs_review", "valid", "pushed", "push_failed", "invalid", "rolled_back", "clean"]
HIDDEN_ACTION = "resolved_conflict"
ACTIVITY = "activity:"


def run_stats(mappings: DataFrame, records: DataFrame, questions: DataFrame, audit: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run; each table is aggregated to run_id before the join."""
    r = records.groupBy("run_id").agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "needs_review", "pushed", "push_failed")],
    )
    m = mappings.groupBy("run_id").agg(
        F.count_if(F.col("status") == "auto_applied").alias("auto_mappings"),
        F.count_if((F.col("status") == "auto_applied") & (F.col("method") == "llm")).alias("llm_mappings"),
    )
    a = audit.where(F.col("action") == "cleaned_value").groupBy("run_id").agg(F.count("*").alias("auto_cleans"))
    q = questions.groupBy("run_id").agg(
        F.count("*").alias("escalations"),
        F.count_if(F.col("status") == "open").alias("escalations_open"),
        human_resolved().alias("escalations_resolved"),
    )
    counts = [c for t in (r, m, a, q) for c in t.columns if c != "run_id"]
    joined = runs.select("run_id")
    for t in (r, m, a, q):
        joined = joined.join(t, "run_id", "left")
    filled = joined.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return with_stp(filled)


def with_stp(stats: DataFrame) -> DataFrame:
    """Share of decisions made without a person; 1.0 where there was none to make."""
    wins = F.col("auto_mappings") + F.col("auto_cleans")
    total = wins + F.col("escalations")
    return stats.withColumn("stp_rate", F.when(total == 0, F.lit(1.0)).otherwise(F.round(wins / total, 3)))


def human_resolved() -> Column:
    return F.count_if((F.col("status") == "resolved") & (F.coalesce("resolved_by", F.lit("")) != "agent"))


def of_run(df: DataFrame, run: int | None) -> DataFrame:
    """Rows of one run: a filter that prunes a table partitioned by run."""
    return df if run is None else df.where(F.col("run_id") == run)


def by_status(df: DataFrame, status: str = "", run: int | None = None) -> DataFrame:
    own = of_run(df, run)
    return own.where(F.col("status") == status) if status else own


def status_facets(records: DataFrame, by: str = "run_id") -> DataFrame:
    place = F.array_position(F.array(*[F.lit(s) for s in FACET_ORDER]), F.col("status"))
    return records.groupBy(by, "status").agg(F.count("*").alias("n")).withColumn("place", place.cast("int"))


def question_subjects(questions: DataFrame, records: DataFrame, name_field: str, run: int | None = None) -> DataFrame:
    """Display name of the record each question is about: one row per question.

    Names are looked up within the question's run. Where several records of a run share a
    key, the smallest name is shown.
    """
    named = (
        of_run(records, run).where(F.trim(F.col(name_field)) != "")
        .groupBy("run_id", F.col("natural_key").alias("record")).agg(F.min(name_field).alias("_name"))
    )
    bare = F.regexp_replace("record", "^[^:]*:", "")
    readable = F.when(F.col("record").startswith("id:"), F.concat(F.lit("#"), bare)).otherwise(bare)
    return of_run(questions, run).join(named, ["run_id", "record"], "left").withColumn(
        "subject", F.coalesce("_name", readable)
    ).drop("_name")


def activity_since(audit: DataFrame, cursor: Column | int, run: int | None = None) -> DataFrame:
    """Stage events after a cursor; works on a batch and on a stream alike."""
    return of_run(audit, run).where(F.col("action").startswith(ACTIVITY) & (F.col("id") > cursor)).select(
        "id", "run_id", "ts", F.regexp_replace("action", f"^{ACTIVITY}", "").alias("stage"),
        F.col("reason").alias("message"),
    )


def audit_log(audit: DataFrame, run: int | None = None) -> DataFrame:
    """The whole trail, of one run or of all, in order."""
    return of_run(audit, run).orderBy("id")


def audit_view(audit: DataFrame, actor: str = "all", run: int | None = None) -> DataFrame:
    """The trail a person reads: without stage events and doubled entries."""
    own = of_run(audit, run)
    shown = own.where(~F.col("action").startswith(ACTIVITY) & (F.col("action") != HIDDEN_ACTION))
    return shown if actor == "all" else shown.where(F.col("actor") == actor)


def human_actions(audit: DataFrame) -> DataFrame:
    own = (F.col("actor") == "human") & (F.col("action") != HIDDEN_ACTION)
    return audit.groupBy("run_id").agg(F.count_if(own).alias("human_actions"))
