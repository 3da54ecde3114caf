"""The question queue as keyed state of a stream of events.

Events: run_id, seq, kind, type, entity_ref, resolved_by. ``raised`` puts a question, ``resolved`` and
``rejected`` answer it, ``built`` says that a build of the run is complete. Of one ``seq``, raised comes
before built. A question that is open stays one however often it is raised; one that was answered
opens anew. A build closes the open record questions that it did not raise again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.questions import RECORD_TYPES

EVENTS = "run_id bigint, seq bigint, kind string, type string, entity_ref string, resolved_by string"
CHANGES = "run_id bigint, seq bigint, type string, entity_ref string, status string, resolved_by string, opened bigint"
EVENT = ["seq", "kind", "type", "entity_ref", "resolved_by"]
CHANGE = [c.split()[0] for c in CHANGES.split(", ")]
# The questions of a (run, part): status, who resolved it, last raised and how often opened, by type and entity_ref.
QUESTIONS = (
    "type array<string>, entity_ref array<string>, status array<string>, resolved_by array<string>, raised array<bigint>, opened array<bigint>"
)
# The same of all runs of a (bucket, part).
QUESTIONS_OF_RUNS = f"run_id array<bigint>, {QUESTIONS}"
# Parts of a run that hold state apart, so that a large run is spread; and buckets of runs that share their state, so
# that many small runs are few groups.
PARTS, RUN_BUCKETS = 32, 128
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One (run, part): its events of this batch, after its questions so far.

    The state comes and goes with the rows, whole: nothing is asked of the store for a single event.
    """
    held = {(x[0], x[1]): x[2:] for x in zip(*state.get, strict=True)} if state.exists else {}
    run = None if pd.isna(key[0]) else int(key[0])
    out = _changes(run, [e for b in batches for e in zip(*(b[c].tolist() for c in EVENT), strict=True)], held)
    if out:
        rows = zip(*[(*subject, *value) for subject, value in held.items()], strict=True)
        state.update(tuple(list(x) for x in rows))
        yield pd.DataFrame(out, columns=CHANGE)


def advance_runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One (bucket, part): the events of all its runs, each run as by :func:`advance`. The bucket below zero has those without a run."""
    held: dict[int, dict] = {}
    for run, type_, ref, *value in zip(*state.get, strict=True) if state.exists else ():
        held.setdefault(run, {})[type_, ref] = tuple(value)
    events: dict[int, list[tuple]] = {}
    for b in batches:
        for run, *event in zip(*(b[c].tolist() for c in ("run_id", *EVENT)), strict=True):
            events.setdefault(run, []).append(tuple(event))
    out = [x for run, own in events.items() for x in _changes(None if key[0] < 0 else run, own, held.setdefault(run, {}))]
    if out:
        rows = zip(*[(run, *subject, *value) for run, own in held.items() for subject, value in own.items()], strict=True)
        state.update(tuple(list(x) for x in rows))
        yield pd.DataFrame(out, columns=CHANGE)


def _changes(run: int | None, events: list[tuple], held: dict[tuple, tuple]) -> list[tuple]:
    """What events change in the questions of a run."""
    out: list[tuple] = []

    def put(seq: int, subject: tuple, value: tuple) -> None:
        held[subject] = value
        out.append((run, seq, *subject, value[0], value[1], value[3]))

    # Of one seq, the end of a build comes last.
    for seq, kind, type_, ref, who in sorted(events, key=lambda e: (e[0], e[1] == "built")):
        if kind == "built":
            for subject, (status, _, raised, opened) in list(held.items()):
                if status == "open" and subject[0] in RECORD_TYPES and raised < seq:
                    put(seq, subject, ("resolved", "agent", raised, opened))
            continue
        subject = (type_, ref)
        status, _, raised, opened = held.get(subject, (None, None, None, 0))
        if kind == "raised":
            put(seq, subject, ("open", None, seq, opened + (status != "open")))
        elif status == "open":
            put(seq, subject, (kind, who, raised, opened))
    return out


def placed(events: DataFrame) -> DataFrame:
    """Events with the bucket of their run and their part; the end of a build is told to all parts of its run."""
    part = F.pmod(F.xxhash64("type", "entity_ref"), F.lit(PARTS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))
    bucket = F.when(F.col("run_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).cast("int"))
    return events.select(
        bucket.alias("bucket"), F.explode(F.when(F.col("kind") == "built", every).otherwise(F.array(part))).alias("part"),
        F.coalesce("run_id", F.lit(0)).alias("run_id"), *EVENT,
    )


def follow_queue(events: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Write the changes of the queue to ``out``; state and place in the stream are kept under ``checkpoint``."""
    spark = events.sparkSession
    for name, value in STATE.items():
        spark.conf.set(name, value)
    wanted = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions or wanted)
    try:
        changes = placed(events).groupBy("bucket", "part").applyInPandasWithState(
            advance_runs, CHANGES, QUESTIONS_OF_RUNS, "append", GroupStateTimeout.NoTimeout
        )
        return (
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wanted)


def queue_of(changes: DataFrame) -> DataFrame:
    """The queue as the changes leave it: one row per question."""
    newest = changes.groupBy("run_id", "type", "entity_ref").agg(F.max(F.struct("seq", "opened", "status", "resolved_by")).alias("c"))
    return newest.select("run_id", "type", "entity_ref", "c.status", "c.resolved_by", "c.opened")
