"""Operator 12: repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``. Along its rows, that is an automaton of
four states: nothing yet, after s, after u, after a. Edits cost: keep 0, rerole to user or assistant 2,
delete 3 (demanded for blank and duplicate rows), insert an empty user or assistant row 2; a truncated
row that stays adds 1. The cheapest edits are wanted, of these the audit string that is least in ASCII.

A step (a row, a run of rows, the end) is a 4 x 4 table: the least cost from state to state, and the
rank of its least audit among those that leave one state. Inserted rows count to the row that follows.
So the audits that reach a row in two states have as many letters other than I and end in one: neither
begins with the other, and ranks decide every later tie. No audit is stored on the way.

Hirschberg: forward vectors (cost, rank) of the first half and backward vectors (cost) of the second meet
in the middle; the cheapest crossing with the least rank is the state there; both halves are solved alike.
That takes linear space. It is used on three levels, so that no conversation has to fit into a task: the
ordered rows are cut into blocks, blocks of a partition make a run, and a conversation has one run a
partition. Runs are crossed first, then the blocks of each run, then the rows of each block.

Rows are ordered by turn (nulls first), role and a digest of role and text; equal rows are neighbours.
Null roles and texts count as one space; a null conv_id is a conversation of its own. An empty table
gives no rows. Other columns are ignored, so their names may clash with anything here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_batches

BLOCK_ROWS = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
OTHER = 0
# The state after an inserted or reroled row, and the rows to insert at the end.
AFTER = (USER, USER, ASSISTANT, USER)
AT_END = (0, 2, 1, 0)
NO_FAULT, TRUNCATED, BLANK, DUPLICATE = range(4)
SPACE = r"\x20\x09-\x0D"

Vector = tuple  # per state (cost, rank) or None
Step = tuple  # per state a Vector
UNIT: tuple[Vector, ...] = tuple(tuple((0, 0) if p == q else None for q in range(4)) for p in range(4))


# ------------------------------------------------------------------ the automaton of edits
def kind_of(initial: int, fault: int) -> int:
    return initial * 4 + fault


@lru_cache(None)
def edits_of(kind: int, state: int) -> dict[int, tuple[int, str]]:
    """Per next state: cost and audit of the cheapest, least way over one row."""
    initial, fault = divmod(kind, 4)
    out: dict[int, tuple[int, str]] = {}
    cost, audit = 0, ""
    for _ in range(3):
        ways = [(state, cost + 3, audit + "D")]
        if fault < BLANK:
            stays = cost + (fault == TRUNCATED)
            ways.append((AFTER[state], stays + 2, audit + "R"))
            if initial == AFTER[state] or (initial == SYSTEM and state == START):
                ways.append((initial, stays, audit + "K"))
        for to, *way in ways:
            out[to] = min(out.get(to, (1 << 60, "")), tuple(way))
        state, cost, audit = AFTER[state], cost + 2, audit + "I"
    return out


def _ranked(best: dict[int, tuple]) -> Vector:
    """(cost, rank) per state from (cost, order) per state."""
    order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:]))}
    return tuple((best[s][0], order[s]) if s in best else None for s in range(4))


@lru_cache(None)
def row_step(kind: int) -> Step:
    return tuple(_ranked(edits_of(kind, state)) for state in range(4))


#: The end of a conversation: inserts up to a legal end, then state START.
END: Step = tuple(((2 * AT_END[s], 0), None, None, None) for s in range(4))


def through(vector: Vector, step: Step) -> Vector:
    """The forward vector behind a step."""
    best: dict[int, tuple] = {}
    for state, reached in enumerate(vector):
        if reached is None:
            continue
        for to, way in enumerate(step[state]):
            if way is not None:
                found = (reached[0] + way[0], reached[1], way[1])
                if to not in best or found < best[to]:
                    best[to] = found
    return _ranked(best)


def before(step: Step, costs: tuple) -> tuple:
    """The backward vector (costs) in front of a step."""
    out = []
    for state in range(4):
        ways = [way[0] + costs[to] for to, way in enumerate(step[state]) if way is not None and costs[to] is not None]
        out.append(min(ways, default=None))
    return tuple(out)


@lru_cache(1 << 16)
def _through_row(vector: Vector, kind: int) -> tuple[Vector, int]:
    """The vector behind a row, less its least cost; and that cost. Few vectors occur, so this is a look-up."""
    out = through(vector, row_step(kind))
    least = min(v[0] for v in out if v)
    return tuple(v and (v[0] - least, v[1]) for v in out), least


@lru_cache(1 << 16)
def _before_row(kind: int, costs: tuple) -> tuple:
    out = before(row_step(kind), costs)
    least = min(c for c in out if c is not None)
    return tuple(None if c is None else c - least for c in out)


def crossings(steps: list, start: int, end: int) -> list[int]:
    """The state in front of each step and behind the last. A step is a Step or the kind of a row."""
    out = [start] * (len(steps) + 1)
    out[-1] = end
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        forward = UNIT[out[lo]]
        for step in steps[lo:mid]:
            forward = _through_row(forward, step)[0] if isinstance(step, int) else through(forward, step)
        back: tuple = tuple(0 if s == out[hi] else None for s in range(4))
        for step in reversed(steps[mid:hi]):
            back = _before_row(step, back) if isinstance(step, int) else before(step, back)
        met = [(f[0] + b, f[1], s) for s, (f, b) in enumerate(zip(forward, back, strict=True)) if f is not None and b is not None]
        out[mid] = min(met)[2]
        todo += [(lo, mid), (mid, hi)]
    return out


# ------------------------------------------------------------------ rows, runs and blocks
class Repair(NamedTuple):
    """``edits``: one row per given row, keyed by (conv_id, turn, role, said), ordered within a conversation by
    (run, block, at): fault, the state in front of it, audit (inserts and the row's own edit).
    ``ends``: (conv_id, end): rows to insert behind the last.
    """

    edits: DataFrame
    ends: DataFrame


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, said: nulls replaced, ``said`` is the digest of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    plain = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    return plain.withColumn("said", said)


def _keys(rows: DataFrame) -> DataFrame:
    """One row per (conv_id, turn, role, said): how often it comes, whether it is blank, truncated, the first of its kind."""
    bare = F.regexp_replace("text", f"[{SPACE}]+$", "")
    fault = F.when(bare == "", BLANK).when(bare.rlike(r"[.!?]\z"), NO_FAULT).otherwise(TRUNCATED)
    keys = stage(
        rows.groupBy("conv_id", "turn", "role", "said").agg(F.count("*").alias("n"), F.max(fault).alias("fault")), "turns"
    )
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = keys.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(turn).alias("first"))
    same = keys["conv_id"].eqNullSafe(firsts["c"]) & (keys["said"] == firsts["s"])
    new = F.col("first").getField("turn").eqNullSafe(F.col("turn"))
    return keys.join(firsts, same).select("conv_id", "turn", "role", "said", "n", "fault", new.alias("new"))


def _blocks(ordered: DataFrame, conv_type: str, block_rows: int) -> DataFrame:
    """Blocks of at most ``block_rows`` rows of one conversation with their step; behind them a row for each run.

    ``run`` numbers the pieces of conversations in order of partition and place; a run's own row has block -1.
    """
    kind = f"conv_id {conv_type}, run long, block int, step array<int>, kinds binary, turns array<long>, roles array<string>, saids array<binary>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        for conv, own in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), itemgetter(0)):
            run += 1
            block, whole = 0, UNIT
            kinds, turns, roles, saids = bytearray(), [], [], []

            def closed():
                step = []
                for vector in UNIT:
                    total = 0
                    for k in kinds:
                        vector, more = _through_row(vector, k)
                        total += more
                    step.append(tuple(v and (v[0] + total, v[1]) for v in vector))
                return tuple(step)

            for _, turn, role, said, n, fault, new in own:
                first = INITIALS.get(role[:1], OTHER)
                for i in range(n):
                    kinds.append(kind_of(first, fault if fault == BLANK or (new and not i) else DUPLICATE))
                    turns.append(turn)
                    roles.append(role)
                    saids.append(said)
                    if len(kinds) == block_rows:
                        step = closed()
                        out.append((conv, run, block, _flat(step), bytes(kinds), turns, roles, saids))
                        whole = tuple(through(v, step) for v in whole)
                        block, kinds, turns, roles, saids = block + 1, bytearray(), [], [], []
            if kinds:
                step = closed()
                out.append((conv, run, block, _flat(step), bytes(kinds), turns, roles, saids))
                whole = tuple(through(v, step) for v in whole)
            out.append((conv, run, -1, _flat(whole), None, None, None, None))
            if len(out) > 2000:
                yield _table(out, schema)
                out = []
        if out:
            yield _table(out, schema)

    schema = _arrow(ordered.sparkSession, kind)
    return map_batches(ordered, cut, kind)


def _flat(step: Step) -> list[int]:
    return [x for vector in step for v in vector for x in (v or (-1, -1))]


def _step(flat: list[int]) -> Step:
    pairs = [None if c < 0 else (c, r) for c, r in zip(flat[::2], flat[1::2], strict=True)]
    return tuple(tuple(pairs[i : i + 4]) for i in range(0, 16, 4))


def _arrow(spark, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _streamed(df: DataFrame, by: list[str], order: list[str], fn, kind: str) -> DataFrame:
    """``fn(key, rows)`` yields output rows for each group of ``by``, whose rows come in ``order``.

    The rows are a stream; whether a group has to fit into memory is up to ``fn``.
    """
    width, schema = len(by), _arrow(df.sparkSession, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for key, own in groupby(rows, lambda r: r[:width]):
            for row in fn(key, own):
                out.append(row)
                if len(out) > 10_000:
                    yield _table(out, schema)
                    out = []
        if out:
            yield _table(out, schema)

    return map_batches(df.repartition(*by).sortWithinPartitions(*by, *order), run, kind)


def _cross_runs(key, rows):
    """States of a conversation's runs, at most one a partition; the last row says how it ends."""
    runs = list(rows)
    states = crossings([*(_step(r[2]) for r in runs), END], START, START)
    for r, a, b in zip(runs, states, states[1:], strict=False):
        yield r[0], r[1], a, b, None
    yield key[0], None, None, None, AT_END[states[-2]]


def _cross_blocks(key, rows):
    """States of the blocks of one run: one for each ``block_rows`` rows of a partition."""
    blocks = list(rows)
    states = crossings([_step(r[2]) for r in blocks], blocks[0][3], blocks[0][4])
    for r, a, b in zip(blocks, states, states[1:], strict=False):
        yield r[0], r[1], a, b


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repair:
    """The cheapest edits of every conversation in ``rows_of(...)``."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    keys = stage(_keys(rows), "turn-keys")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "said"]
    # Keys are unique, so ranges of them split the longest conversation over partitions.
    blocks = stage(_blocks(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order), conv_type, block_rows), "blocks")
    runs = stage(
        _streamed(
            blocks.where("block = -1").select("conv_id", "run", "step"), ["conv_id"], ["run"], _cross_runs,
            f"conv_id {conv_type}, run long, enter int, leave int, end int",
        ), "runs",
    )
    crossed = _streamed(
        blocks.where("block >= 0").select("run", "block", "step").join(runs.where("run IS NOT NULL").drop("conv_id", "end"), "run"),
        ["run"], ["block"], _cross_blocks, "run long, block int, enter int, leave int",
    )

    kind = f"conv_id {conv_type}, run long, block int, at int, turn long, role string, said binary, fault int, state int, audit string"
    schema = _arrow(rows.sparkSession, kind)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for conv, run, block, enter, leave, kinds, turns, roles, saids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                states = crossings(list(kinds), enter, leave)
                out += [
                    (conv, run, block, at, turn, role, said, k % 4, states[at], edits_of(k, states[at])[states[at + 1]][1])
                    for at, (k, turn, role, said) in enumerate(zip(kinds, turns, roles, saids, strict=True))
                ]
                if len(out) > 10_000:
                    yield _table(out, schema)
                    out = []
        if out:
            yield _table(out, schema)

    whole = blocks.where("block >= 0").drop("step").join(crossed, ["run", "block"]).select(
        "conv_id", "run", "block", "enter", "leave", "kinds", "turns", "roles", "saids"
    )
    return Repair(stage(map_batches(whole, solved, kind), "edits"), runs.where("run IS NULL").select("conv_id", "end"))


# ------------------------------------------------------------------ results
def repaired_rows(rows: DataFrame, fixed: Repair) -> DataFrame:
    """The rows of every repaired conversation: conv_id, run, block, at, nth, role, text.

    (run, block, at, nth) orders a conversation; inserted rows have empty texts; those at its end a null run
    and come last.
    """
    text = rows.groupBy("conv_id", "turn", "role", "said").agg(F.first("text").alias("text"))
    t, e = text.alias("t"), fixed.edits.alias("e")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("conv_id", "turn", "role", "said")]

    def role_at(n):
        """Behind a state, user and assistant alternate."""
        return F.when((F.when(F.col("state") == USER, 1).otherwise(0) + n) % 2 == 0, "user").otherwise("assistant")

    own = F.length("audit") - 1
    edit = F.substring("audit", -1, 1)
    kept = (
        e.where(edit != "D").join(t, (same[0]) & same[1] & same[2] & same[3])
        .select("e.conv_id", "run", "block", "at", own.alias("nth"), F.when(edit == "K", F.col("e.role")).otherwise(role_at(own)).alias("role"), "text")
    )
    more = (
        fixed.edits.where(own > 0).withColumn("nth", F.explode(F.sequence(F.lit(0), own - 1)))
        .select("conv_id", "run", "block", "at", "nth", role_at(F.col("nth")).alias("role"), F.lit("").alias("text"))
    )
    # The last row is always an assistant's: one insert adds it, two add a user's before it.
    last = F.when(F.col("nth") == F.col("end") - 1, "assistant").otherwise("user")
    none = F.lit(None)
    ends = (
        fixed.ends.where("end > 0").withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("end") - 1)))
        .select("conv_id", none.cast("long").alias("run"), none.cast("int").alias("block"), none.cast("int").alias("at"), "nth",
                last.alias("role"), F.lit("").alias("text"))
    )
    return kept.unionByName(more).unionByName(ends)


_SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_COST = {"K": 0, "I": 2, "R": 2, "D": 3}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _summary(key, rows):
    """One conversation as a stream of a marker, and texts each followed by their edits: constant memory but the audit."""
    faults, illegal, cost, audit = [0] * 4, 0, 0, []
    least = most = turn = None
    turns, last, state, text = 0, None, START, None
    sha, any_row = hashlib.sha256(), False

    def say(role, said):
        nonlocal any_row
        sha.update(f"{chr(10) * any_row}{role}:{said}".encode())
        any_row = True

    def insert():
        nonlocal state
        state = AFTER[state]
        say(ROLE_OF[state], "")

    for _, now, role, _, tag, given, _, _, _, fault, steps in rows:
        if tag == 1:
            text = given
        if tag != 2:
            continue
        if now is not None and (turns == 0 or now != turn):
            turn, turns, most = now, turns + 1, now
            least = now if least is None else least
        initial = INITIALS.get(role[:1], OTHER)
        if last is not None and (last, initial) not in _LEGAL:
            illegal += 1
        last = initial
        faults[fault] += 1
        audit.append(steps)
        for c in steps:
            cost += _COST[c]
            if c == "I":
                insert()
            elif c == "K":
                state = initial
                say(role, text)
            elif c == "R":
                state = AFTER[state]
                say(ROLE_OF[state], text)
        cost += fault == TRUNCATED and steps[-1] != "D"
    for _ in range(AT_END[state]):
        audit.append("I")
        cost += 2
        insert()
    gaps = min(most - least + 1 - turns, (1 << 63) - 1) if turns else 0
    yield (key[0], gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, "".join(audit), sha.hexdigest())


def summaries(rows: DataFrame, fixed: Repair, conv_ids: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_ids``, rows or none: faults, cost, audit and the digest of what it became.

    SHA-256 takes bytes in order, so the digest of one conversation streams through one task.
    """
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    null = F.lit(None)
    blank = [null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("binary").alias("said")]
    no_edit = [null.cast("long").alias("run"), null.cast("int").alias("block"), null.cast("int").alias("at"),
               null.cast("int").alias("fault"), null.cast("string").alias("audit")]
    names = ["conv_id", "turn", "role", "said", "tag", "text", "run", "block", "at", "fault", "audit"]
    marks = conv_ids.select("conv_id").distinct().select("conv_id", *blank, F.lit(0).alias("tag"), null.cast("string").alias("text"), *no_edit)
    texts = rows.select("conv_id", "turn", "role", "said", F.lit(1).alias("tag"), "text", *no_edit)
    edits = fixed.edits.withColumns({"tag": F.lit(2), "text": null.cast("string")})
    merged = marks.select(*names).unionByName(texts.select(*names)).unionByName(edits.select(*names))
    return _streamed(merged, ["conv_id"], ["turn", "role", "said", "tag", "run", "block", "at"], _summary, f"conv_id {conv_type}, {_SUMMARY}")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after planted damage, chosen by the checksum of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("harm"))
        .where("harm <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("nth"),
        )
        .drop("nth")
    )

