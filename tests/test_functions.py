"""Column functions against plain Python on generated values."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tributary.functions import dates as D
from tributary.functions import text as T
from tributary.functions.similarity import common_lengths, common_with, lcs, token_sort_score


def table_lcs(a: str, b: str) -> int:
    row = [0] * (len(a) + 1)
    for ch in b:
        new = [0]
        for j, x in enumerate(a):
            new.append(max(row[j + 1], new[-1], row[j] + 1 if x == ch else 0))
        row = new
    return row[-1]


def test_lcs_matches_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcAé ", k=rng.choice([0, 1, 5, 20, 61, 62, 63, 70]))) for _ in range(60)]
    pairs = [(a, rng.choice(words)) for a in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lcs(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [table_lcs(r["a"], r["b"]) for r in got]


def test_token_sort_score(spark):
    cases = [("Grade", "full_name", 286), ("b a", "a b", 1000), ("", "", 1000), ("abc", "", 0), ("ABC", "abc", 0),
             ("PersonalEmail", "personal email", 815)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r[0] for r in rows.select(token_sort_score(F.col("a"), F.col("b"))).collect()]
    want = []
    for a, b, _ in cases:
        x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        total = len(x) + len(y)
        want.append(1000 if total == 0 else round(2000 * table_lcs(x, y) / total))
    assert got == want


# How a day may be written, with the labels under which each spelling can be read.
MONTHS = "January February March April May June July August September October November December".split()


def spelled_days(rng):
    """(text, {label: day}) made from a known day and a known way to write it."""
    year, month, day = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
    true, mark = f"{year}-{month:02}-{day:02}", rng.choice("-/")
    swapped = f"{year}-{day:02}-{month:02}"
    kind = rng.choice(["iso", "day first", "month first", "short", "long"])
    if kind == "iso":
        return f"{year}{mark}{month:02}{mark}{day:02}", {"iso": true}
    if kind == "day first":
        return f"{day:02}{mark}{month:02}{mark}{year}", {"dd/mm": true} | ({"mm/dd": swapped} if day <= 12 else {})
    if kind == "month first":
        return f"{month:02}{mark}{day:02}{mark}{year}", {"mm/dd": true} | ({"dd/mm": swapped} if day <= 12 else {})
    name, gap = MONTHS[month - 1], rng.choice("- ")
    return f"{day:02}{gap}{name[:3] if kind == 'short' else name}{gap}{year}", {"text-month": true}


# Texts on the edge, with their readings worked out by hand.
ODD_DAYS = {
    "": {}, "soon": {}, "2021-02-29": {}, "2020-02-29": {"iso": "2020-02-29"}, "31/04/1999": {},
    "06/06/2021": {"dd/mm": "2021-06-06", "mm/dd": "2021-06-06"}, "0000-01-01": {}, "12-13-2020": {"mm/dd": "2020-12-13"},
    "1-2-99": {}, "3/4-2020": {}, "01 SEPTEMBER 2020": {"text-month": "2020-09-01"}, "5-may-2021": {"text-month": "2021-05-05"},
    "5 May-2021": {}, "2021-1-2": {"iso": "2021-01-02"}, "99/99/2020": {}, "00-01-2020": {},
}


def test_date_readings(spark):
    rng = random.Random(2)
    cases = ODD_DAYS | dict(spelled_days(rng) for _ in range(300))
    rows = spark.createDataFrame([(v,) for v in cases], "v string")
    got = rows.select("v", D.readings(F.col("v")).alias("r"), D.sole_label(F.col("v")).alias("one")).collect()
    for r in got:
        want = cases[r["v"]]
        assert {x["format"]: x["parsed"] for x in r["r"]} == want, r["v"]
        assert (D.LABELS[r["one"] - 1] if r["one"] else None) == (next(iter(want)) if len(want) == 1 else None)


def test_text_functions(spark):
    values = ["  Ann \t B C ", "O'NEIL r&d qa/test 3rd HR", "+91-98 (7)+6", "1,234.50", "n/k", "a@b.co", "a b@c.d", "é ÉCOLE", ""]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    c = F.col("v")
    got = rows.select(
        "v", T.squeeze(c).alias("s"), T.title_case(c).alias("t"), T.phone(c).alias("p"), T.is_email(c).alias("e"), T.is_number(c).alias("n"),
    ).collect()
    for r in got:
        assert r["s"] == " ".join(r["v"].split())
        assert r["t"] == r["v"].title()
    assert {r["v"]: r["p"] for r in got}["+91-98 (7)+6"] == "+919876"
    assert [r["v"] for r in got if r["e"]] == ["a@b.co"]
    assert [r["v"] for r in got if r["n"]] == ["1,234.50"]


def test_common_lengths_of_whole_batches(spark):
    """Both numpy forms against brute force: texts of any size, beyond one word of state, null and empty."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcAé😀 ", k=rng.choice([0, 1, 5, 62, 63, 64, 130]))) for _ in range(40)]
    pairs = [(a, rng.choice(words)) for a in words]
    assert common_lengths(*map(list, zip(*pairs))).tolist() == [table_lcs(a, b) for a, b in pairs]
    fixed = ["", "ab é", "c" * 70, "A😀b"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate([*words, None])], "i int, w string")
    got = {r["i"]: r["n"] for r in rows.select("i", common_with(fixed)(F.col("w")).alias("n")).collect()}
    assert got == {i: [table_lcs(w, t) for t in fixed] for i, w in enumerate(words)} | {len(words): None}
