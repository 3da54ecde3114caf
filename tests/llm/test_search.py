"""Operators 11 to 13 against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import dialogues, neighbours, variants


# ------------------------------------------------------------------ 11: spelling variants
def plain_words(docs):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if v != w and one_error(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize("unit_words", [5, 2048])
def test_variants(spark, unit_words):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abÀñ") for _ in range(rng.randint(6, 9))) for _ in range(25)]

    def typo(w):
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        return w[:at] + rng.choice(["", "b", "a"]) + w[at + (kind > 0) :]

    docs = []
    for i in range(60):
        held = [w if rng.random() < 0.5 else typo(w) for w in rng.choices(stems, range(25, 0, -1), k=150)]
        docs.append((i, " ".join(held).title() if i % 3 else "x" + "-".join(held)))
    docs += [(None, docs[0][1]), (7, docs[7][1]), (80, None), (81, ""), (82, "9 . ×÷"), (83, "á" * 30000 + " " + "short")]
    docs.append((90, " ".join(["qqqqbcde"] * 6 + ["qqqqbcdf"] * 40 + ["qqqqbcff"] * 250)))  # a chain
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, bucket string").repartition(4)
    got = variants.spelling_variants(frame, unit_words=unit_words).collect()
    words = plain_words(docs)
    assert any(w for w in words) and {tuple(r) for r in got} == plain_variants(words) and len(got) == len(words)
    assert sum(r.form is not None for r in got) > 10 and any(r.root != r.form for r in got if r.form)


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_position_index():
    rng = random.Random(4)
    for size in (1, 2, 5):
        words = sorted({"".join(rng.choice("abc") for _ in range(size + rng.randrange(2))) for _ in range(60)})
        index = variants.PositionIndex(words, size)
        for w in words:
            want = {v for v in words if one_error(v, w) and not (len(w) == len(v) == size + 1)}
            found, _ = index.near(w)
            assert {v for i, v in enumerate(words) if found >> i & 1} == want


# ------------------------------------------------------------------ 12: conversations
def plain_repair(rows):
    """Dijkstra over (row, state) with (cost, audit): (cost, audit, repaired lines)."""
    nexts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    insert = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        role, to = insert[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            own, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*lines, f"{role}:{text}")))
                if own[:1] in nexts[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, nexts[state][own[:1]], (*lines, f"{own}:{text}")))


def plain_summary(rows):
    def order(r):
        said = hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
        return r[0] is not None, r[0] or 0, r[1], said

    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=order)
    seen, judged = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    faults = Counter(f for *_, f in judged)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    cost, audit, lines = plain_repair(judged)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
        illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(rng, n):
    out = {}
    for c in range(n):
        rows = []
        for t in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "", " \t", None, "What? \n", f"t{t}!", "é", "A: b\nc"])
            rows += [(rng.choice([t, t, t * 3, None]), role, text)] * rng.choice([1, 1, 1, 2])
        out[c] = rows
    return out


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_conversations(spark, block_rows):
    rng = random.Random(5)
    given = conversations(rng, 120)
    given[None] = given[3]
    given[500] = [(t, ["user", "assistant", "system"][rng.randrange(3)], rng.choice(["a.", "b", f"{t}."])) for t in range(700)]
    flat = [(c, *r, "x", "x") for c, rows in given.items() for r in rows]
    frame = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, run string, fault string").repartition(5)
    ids = frame.select("conv_id").union(spark.createDataFrame([(900,)], "conv_id long"))
    rows = dialogues.rows_of(frame)
    fixed = dialogues.repair(rows, block_rows)
    got = {r[0]: tuple(r)[1:] for r in dialogues.summaries(rows, fixed, ids).collect()}
    assert len(got) == len(given) + 1
    assert got.pop(900) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c, own in given.items():
        assert got[c] == plain_summary(own), c
    # The rows of the general interface are those the digest was taken of.
    made = {}
    for r in sorted(dialogues.repaired_rows(rows, fixed).collect(), key=lambda r: (r.run is None, r.run, r.block, r.at, r.nth)):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c in given:
        assert hashlib.sha256("\n".join(made.get(c, [])).encode()).hexdigest() == got[c][-1], c


def test_conversations_of_nothing_and_string_ids(spark):
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    rows = dialogues.rows_of(empty)
    assert dialogues.summaries(rows, dialogues.repair(rows), empty).count() == 0
    one = spark.createDataFrame([("c", 1, "user", "x" * 200_000)], empty.schema)
    rows = dialogues.rows_of(one)
    assert [(r.audit, r.cost) for r in dialogues.summaries(rows, dialogues.repair(rows), one).collect()] == [("D", 3)]


def test_damage(spark):
    rows = [(c, t, "assistant", "Ab. Cd!") for c in (1, None) for t in (*range(60), None)]
    got = Counter(tuple(r) for r in dialogues.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if harm:
            want[(c, t, "user" if harm == 4 else role, {1: "", 2: "Ab Cd"}.get(harm, text))] += 1 + (harm == 3)
    assert got == want


# ------------------------------------------------------------------ 13: neighbours
def frame_of(spark, ids, x, kind="array<double>"):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "x") for i, r in zip(ids, x)], f"id long, v {kind}, bucket string")


def dot(a, b):
    """Plain doubles in order; sum() would compensate for rounding."""
    total = 0.0
    for u, v in zip(a.tolist(), b.tolist()):
        total += u * v
    return total


def exact(ids, x, queries, k):
    out = {}
    for i in queries:
        q = x[list(ids).index(i)]
        scored = sorted((-dot(q, r), j) for j, r in zip(ids, x) if j != i)
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = neighbours.hadamard(x)
    assert np.allclose((y**2).sum(axis=1), (x**2).sum(axis=1)) and np.allclose(neighbours.hadamard(y), x)


def test_probes_fall_and_begin_with_the_own_bucket():
    x = np.random.default_rng(2).normal(size=(20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for bits in (1, 3, 5, 9):
        code = neighbours.CrossPolytope(8, 1.0, bits, 3)
        for own, listed in zip(code.buckets(x).T, code.probes(x, 1 << bits), strict=True):
            assert (listed[:, 0] == own).mean() > 0.9  # axes that tie may come in either order
            assert all(sorted(p) == list(range(1 << bits)) for p in listed.tolist())


@pytest.mark.parametrize("unit_rows", [40, 8192])
def test_neighbours(spark, monkeypatch, unit_rows):
    monkeypatch.setattr(neighbours, "UNIT_ROWS", unit_rows)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:330] = x[5]  # copies
    x[400:450] *= 4  # longer ones
    ids = np.arange(600)
    found = neighbours.nearest(frame_of(spark, ids, x), F.col("vec_id") % 20 == 0, 5, "id", "v", bucket_rows=20)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(ids, x, range(0, 600, 20), 5)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and len(rows) == 5
        assert all(s == dot(x[q], x[j]) for j, s in rows)


def test_neighbours_edge_cases(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, []),
        (8, [float("nan"), 1.0]), (9, [float("inf"), 0.0]), (10, [None, 1.0]), (None, [1.0, 1.0]), (11, [2.0]), (40, [0.0, 0.0]), (12, [1e200, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [
        (0, 1, 12), (0, 2, 11), (0, 3, 3), (0, 4, 4), (0, 5, 20), (20, 1, 12), (20, 2, 11), (20, 3, 0), (20, 4, 3), (20, 5, 4),
    ]
    assert [r[3] for r in got] == [1e200, 2.0, 1.0, 1.0, 0.5, 5e199, 1.0, 0.5, 0.5, 0.5]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 3"), F.lit(True)).count() == 0
    assert neighbours.nearest(frame.where("vec_id < 5"), F.col("vec_id") == 99).count() == 0
