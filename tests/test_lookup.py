"""Best matches over blocks against brute force."""

from __future__ import annotations

import random


import numpy as np

from tributary.operators import lookup as L
from tributary.operators.keytrie import KeyTrie


def naive(a: str, b: str) -> int:
    row = [0] * (len(a) + 1)
    for ch in b:
        new = [0]
        for j, x in enumerate(a):
            new.append(max(row[j + 1], new[-1], row[j] + 1 if x == ch else 0))
        row = new
    return row[-1]


def test_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "KEY_BLOCK", 7)
    monkeypatch.setattr(L, "VALUE_BLOCK", 3)
    monkeypatch.setattr(L, "BEAM", 2)
    rng = random.Random(6)
    keys = sorted({"".join(rng.choices("abcd.@é", k=rng.choice([1, 6, 12, 70, 130]))) for _ in range(40)})
    values = sorted({"".join(rng.choices("abcd é", k=rng.choice([2, 8, 66, 140]))).strip() or "a" for _ in range(12)})
    got = L.top_matches(
        spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(k,) for k in keys], "key string"),
        3,
    ).orderBy("value", "rank").select("value", "key", "score").collect()

    def score(v, k):
        a, b = " ".join(sorted(v.split())), " ".join(sorted(k.split()))
        n, total = 2000 * naive(a, b), len(a) + len(b)
        low, rest = divmod(n, total)
        return low + (2 * rest > total or (2 * rest == total and low % 2 == 1))

    want = [(v, k, s) for v in values for k, s in sorted(((k, score(v, k)) for k in keys), key=lambda p: (-p[1], p[0]))[:3]]
    assert [tuple(r) for r in got] == want


def test_ten_times_the_data_is_less_than_thirty_times_the_work(spark):
    """Ids in addresses against ids in names, as in the exports: no value shares more than some digits with a key."""
    seen = []
    for n in (1, 10):
        values = spark.range(100 * n).selectExpr("concat('Customer#', lpad(id * 7, 9, '0')) AS value")
        keys = spark.range(1000 * n).selectExpr("concat('c', id, if(id % 3 = 0, ' ', ''), '@acme.com') AS key")
        matches = L.search_matches(values, keys)
        assert matches.best.groupBy("value").count().where("count = 3").count() == 100 * n
        seen.append(matches.compared)
    assert seen[1] < 30 * seen[0]


def test_trie_of_repeated_ends_and_long_counts():
    texts = ["a" * 300, "a" * 299 + "b", "", "b", "ab", "abc"]
    trie = KeyTrie(texts)
    value, place, score, _ = trie.search(["a" * 280, ""], np.zeros(2, np.int64), 2)
    best = {(int(v), trie.texts[p]): int(s) for v, p, s in zip(value, place, score)}
    assert best[(0, "a" * 300)] == round(2000 * 280 / 580) and best[(0, "a" * 299 + "b")] == round(2000 * 280 / 580)
    assert best[(1, "")] == 1000


def test_neither_side_is_broadcast(spark, monkeypatch):
    """Blocks of keys and values meet by a shuffle: what the driver holds does not grow with them."""
    plans = []
    kept = L.stage

    def noting(df, name):
        if name == "matches":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(L, "stage", noting)
    values = spark.range(50).selectExpr("concat('Customer#', id) AS value")
    keys = spark.range(500).selectExpr("concat('c', id, '@acme.com') AS key")
    assert L.top_matches(values, keys).count() == 150
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_texts_that_share_their_ends_or_their_beginnings():
    """Either way round a text is in a small trie, whatever the others share."""
    texts = [f"{i}C moc.emca@" for i in range(2000)] + [f"moc.emca@{i}c" for i in range(2000)]
    trie = KeyTrie(texts)
    assert sum(len(level.letter) for _, _, part in trie.parts for level in part.levels) < 4 * len(texts)
    value, place, score, _ = trie.search(["moc.emca@1234c", "4321C"], np.zeros(2, np.int64), 1)
    best = {}
    for v, p, s in zip(value.tolist(), place.tolist(), score.tolist()):
        best[v] = max(best.get(v, (0, "")), (s, trie.texts[p]))
    assert best[0] == (1000, "moc.emca@1234c")
    assert best[1][0] == max(round(2000 * naive("4321C", t) / (5 + len(t))) for t in texts)


def brute(texts: list[str], value: str, limit: int) -> list[tuple[int, str]]:
    return sorted((-round(2000 * naive(value, t) / (len(value) + len(t))), t) for t in texts)[:limit]


def test_few_nodes_are_visited_and_only_the_best_come_out(monkeypatch):
    """A text follows its own ways down the trie, whatever the texts beside it do; what it must reach rules out the rest."""
    from tributary.operators import keytrie as K

    texts = [f"moc.emca@{str(i)[::-1]}c" for i in range(20000)]
    trie = KeyTrie(texts)
    values = [f"{str(i)[::-1]}0000#remotsuc" for i in range(10007, 20000, 97)] + [f"moc.emca.{str(i)[::-1]}c" for i in range(10007, 20000, 97)]
    looked = []
    bounds = K._Trie._bounds
    monkeypatch.setattr(K._Trie, "_bounds", lambda self, *a: looked.append(len(a[3])) or bounds(self, *a))
    monkeypatch.setattr(K, "PAIRS", 1000)
    monkeypatch.setattr(K, "HELD", 100)
    order = np.arange(len(trie.texts))
    none = np.zeros(len(values), np.int64)
    found = trie.search(values, none, 3, order, 8)
    reached = np.full(len(values), 1001)
    np.minimum.at(reached, found[0], found[2])
    assert np.bincount(found[0], minlength=len(values)).min() == 3
    value, place, score, _ = trie.search(values, reached, 3, order)
    nodes = sum(len(level.letter) for _, _, part in trie.parts for level in part.levels)
    assert sum(looked) < 0.2 * nodes * len(values)
    assert np.bincount(value, minlength=len(values)).tolist() == [3] * len(values)
    for v in (0, 50, len(values) - 1):
        got = [(-int(s), trie.texts[p]) for p, s in zip(place[value == v], score[value == v])]
        assert sorted(got) == brute(texts, values[v], 3)


def test_blocks_near_the_first_matches_miss_nothing(spark, monkeypatch):
    """Many blocks and one way at a time: first passes find little, the last one all."""
    monkeypatch.setattr(L, "KEY_BLOCK", 60)
    monkeypatch.setattr(L, "VALUE_BLOCK", 10)
    monkeypatch.setattr(L, "WAYS", 1)
    monkeypatch.setattr(L, "BEAM", 5)
    keys = [f"c{i}{' ' if i % 3 == 0 else ''}@acme.com" for i in range(0, 2500, 7)] + ["b a", "a b", "b  a"]
    values = [f"customer#{i:06}" for i in range(3, 2500, 101)] + [f"c{i}.acme.com" for i in range(5, 2500, 101)] + ["a b"]
    got = L.top_matches(
        spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    best: dict[str, list[tuple[int, str]]] = {}
    for r in got.orderBy("value", "rank").collect():
        best.setdefault(r["value"], []).append((-r["score"], r["key"]))
    tokens = {k: " ".join(sorted(k.split())) for k in keys}
    for v in values:
        w = " ".join(sorted(v.split()))
        want = sorted((-round(2000 * naive(w, t) / (len(w) + len(t))), k) for k, t in tokens.items())[:3]
        assert best[v] == want
