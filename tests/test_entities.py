"""Components and merges: order of rows, long chains, hubs and hot entities."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tributary.operators import entities as E
from tributary.streaming.feeds import StoredComponents
from tributary.operators import survivorship as S


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(root)}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = {(f"c{i + 1:03d}", f"c{i:03d}") for i in range(60)}  # a chain
    edges |= {(f"h{i:03d}", "a-hub") for i in range(1, 200)}  # a hub
    edges |= {(f"r{rng.randint(0, 80):02d}", f"r{rng.randint(0, 80):02d}") for _ in range(70)}
    edges = {(max(a, b), min(a, b)) for a, b in edges if a != b}
    df = spark.createDataFrame(sorted(edges), "hi string, lo string")
    want = {k: v for k, v in union_find(edges).items() if k != v}
    got = {r["key"]: r["root"] for r in E.connected_components(df).collect()}
    assert got == want


def people(spark, schema, rows):
    cols = "file string, file_ord int, row_idx bigint, " + ", ".join(f"{n} string" for n in schema.names)
    data = [(f, o, i, *[v.get(n) for n in schema.names]) for f, o, i, v in rows]
    return spark.createDataFrame(data, cols)


def test_bridging_row_joins_groups_whatever_the_order(spark, schema):
    rows = [
        ("a", 0, 0, {"employee_id": "E1", "full_name": "One"}),
        ("a", 0, 1, {"email": "X@acme.com", "full_name": "Two"}),
        ("b", 1, 0, {"employee_id": "1", "email": "x@acme.com "}),
        ("b", 1, 1, {"employee_id": "TBD"}),
        ("b", 1, 2, {"employee_id": "none"}),
    ]
    seen = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = E.link_rows(people(spark, schema, order), schema).select("file", "row_idx", "entity_id").collect()
        seen.add(tuple(sorted(map(tuple, got))))
    assert len(seen) == 1
    ids = {(f, i): e for f, i, e in seen.pop()}
    assert ids["a", 0] == ids["a", 1] == ids["b", 0] == "email:x@acme.com"
    assert ids["b", 1] == "unmatched:b:1" and ids["b", 2] == "unmatched:b:2"


def test_hot_entity_is_whole(spark, schema):
    rows = [("a", 0, i, {"employee_id": "E7" if i % 3 else f"E{100 + i}", "department": f"d{i % 5}"}) for i in range(600)]
    linked = E.link_rows(people(spark, schema, rows), schema)
    kept = S.keep_cells(linked, schema)
    found = S.disagreements(linked, kept, schema)
    assert found.where("entity_id = 'id:7'").count() == sum(1 for i in range(600) if i % 3 and i % 5 != 1)
    distinct = S.distinct_disagreements(found).where("entity_id = 'id:7'").select("value").collect()
    assert {r["value"] for r in distinct} == {"d0", "d2", "d3", "d4"}


def test_email_fold_matches_the_sequence(spark, schema):
    def sequential(values):
        kept, conflicts = None, set()
        for v in values:
            if kept is None:
                kept = v
            elif v.strip().lower() == kept.strip().lower():
                pass
            elif ("@" in v) != ("@" in kept):
                kept = v if "@" in v else kept
            else:
                conflicts.add((kept, v))
        return kept, conflicts

    rng = random.Random(4)
    pool = ["Ann", "ann ", "Bob", "a@x.org", "A@x.org", "b@x.org"]
    groups = {f"E{i + 1}": [rng.choice(pool) for _ in range(rng.randint(1, 6))] for i in range(80)}
    rows, n = [], 0
    for key, values in groups.items():
        for v in values:
            rows.append(("a", 0, n, {"employee_id": key, "manager_email": v}))
            n += 1
    linked = E.link_rows(people(spark, schema, rows), schema)
    kept = S.keep_cells(linked, schema)
    got_kept = {r[0]: r[1] for r in kept.select("employee_id__kept.raw", "manager_email__kept.raw").collect()}
    found = S.distinct_disagreements(S.disagreements(linked, kept, schema))
    names = {r["entity_id"]: r[1] for r in kept.select("entity_id", "employee_id__kept.raw").collect()}
    got = {}
    for r in found.where("field = 'manager_email'").collect():
        got.setdefault(names[r["entity_id"]], set()).add((r["kept_value"], r["value"]))
    for key, values in groups.items():
        want_kept, want = sequential(values)
        assert got_kept[key] == want_kept
        assert got.get(key, set()) == want


def test_components_extended_in_batches(spark, tmp_path):
    """Any order of batches gives the components of all edges, and other buckets stay unread."""
    rng = random.Random(9)
    pairs = [(f"k{rng.randrange(80):02d}", f"k{rng.randrange(80):02d}") for _ in range(70)]
    edges = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    frame = lambda rows: spark.createDataFrame(rows, "hi string, lo string")
    want = {r["key"]: r["root"] for r in E.connected_components(frame(edges)).collect()}
    store = StoredComponents(spark, str(tmp_path / "c"), 4)
    for part in (edges[:30], edges[30:33], edges[33:], edges[33:]):
        store = StoredComponents(spark, store.path, 4)
        store.add(frame(part))
    assert {r["key"]: r["root"] for r in store.read().collect()} == want
    assert store.add(frame(edges[:5])).isEmpty()  # nothing new
    # A batch between two new keys opens no bucket but theirs.
    own = {r[0] for r in spark.createDataFrame([("z1",), ("z2",)], "key string").select(store._bucket("key")).collect()}
    for f in (tmp_path / "c").rglob("part-*"):
        bucket = [x for x in f.parts if x.startswith("bucket=")]
        if bucket and int(bucket[0].split("=")[1]) not in own:
            f.write_bytes(b"broken")
    assert [tuple(r) for r in store.add(frame([("z2", "z1")])).collect()] == [("z2", "z1")]
