"""Free-style operators against brute force, round trips and planted cases."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import contamination, mixing, neardup, pages, tokens, toxicity
from tributary.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, texts, start=0):
    rows = [(i, t, ("en", "de", None)[i % 3], "src0" if i % 2 else None, 1, "x", "x", "x") for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ------------------------------------------------------------------ 1: passages
def test_words():
    for text in ["", "Ab-c d_e 9Ä", "ÀÉ x\x7fy\x00z", "日本 語"]:
        assert [w.decode() for w in words_of(text.encode())] == plain_words(text)


def test_fm_index_finds_what_a_scan_finds():
    rng = random.Random(1)
    for _ in range(20):
        docs = [[rng.randint(0, 4) for _ in range(rng.randint(0, 60))] for _ in range(12)]
        docs[3] = docs[2] * 2
        seq = np.array([x for d in docs for x in [*d, 0]], np.int32)
        index = contamination.FMIndex(seq, 5)
        for size in (1, 2, 4):
            phrases = np.array([[rng.randint(1, 4) for _ in range(size)] for _ in range(10)], np.int64)
            for phrase, low, high in zip(phrases, *index.ranges(phrases), strict=True):
                want = [i for i in range(len(seq) - size + 1) if (seq[i : i + size] == phrase).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def plain_passages(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, own in items:
        own = plain_words(own)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), hit, found


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_passages(spark, block_bytes):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(9, 30))) for i in range(12)]
    items += [(90, "tiny Item"), (91, ""), (92, None), (93, items[0][1]), (None, prose(rng, 15))]
    texts = [prose(rng, 80) for _ in range(10)]
    texts += [f"{prose(rng, 20)}. {items[i][1].upper()}! {prose(rng, 9)} {items[-1][1]}" for i in range(8)]
    texts += [items[2][1] * 1, " ".join(items[3][1].split()[:9]), "a tiny item, tiny item", "", None, items[2][1] + " " + items[2][1]]
    docs = frame(spark, texts).repartition(3)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.find_passages(docs, bench, ["doc_id", "key"], False, block_bytes).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, hit, found = plain_passages(text, items)
        r = got[i]
        assert (r.n_words, {w for s in r.spans for w in range(s.start, s.end)}) == (n, hit), i
        assert sorted(r["items"]) == sorted(x for x in found if x is not None) and r.key == "x"
    left = {r.doc_id: r.text for r in contamination.remove_passages(docs, bench, ["doc_id", "text"]).collect()}
    for i, text in enumerate(texts):
        _, hit, _ = plain_passages(text, items)
        if not hit:
            assert left[i] == text
        elif len(hit) == len(plain_words(text)):
            assert i not in left
        else:
            assert plain_words(left[i]) == [w for j, w in enumerate(plain_words(text)) if j not in hit]
    assert contamination.find_passages(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert contamination.find_passages(docs, bench.limit(0), ["doc_id"]).where("size(spans) > 0").count() == 0


# ------------------------------------------------------------------ 2: mixing
def test_raking_meets_the_marginals(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 5}", ("en", "de", "fr")[i % 3], ("a", "b")[i % 2], rng.randint(50, 500)) for i in range(200)]
    cells = spark.createDataFrame(rows, "_m_source string, _m_lang string, _m_topic string, t long").groupBy(
        "_m_source", "_m_lang", "_m_topic").agg(F.sum("t").alias("n"))
    mix = mixing.Mixture({"lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "topic": {"a": 0.4}}, budget=0.3)
    raked = mixing.calibrate(mixing.rake(cells, mix), mix).collect()
    total = sum(r.n for r in raked)
    share = lambda axis, v: sum(r.n * r.ratio for r in raked if r[axis] == v)
    for lang, want in {"en": 0.5, "de": 0.3, "fr": 0.2}.items():
        assert share("_m_lang", lang) == pytest.approx(want, rel=0.01)
    assert share("_m_topic", "a") == pytest.approx(0.4, rel=0.01) and share("_m_topic", "b") == pytest.approx(0.6, rel=0.01)
    assert sum(r.n * r.p for r in raked) == pytest.approx(0.3 * total, rel=0.01) and all(0 <= r.p <= 1 for r in raked)


def plain_rake(cells, mix):
    """{(source, lang, topic): ratio} for {(source, lang, topic): n}, with tempered shares."""
    total = lambda i, v, by: sum(n * by[k] for k, n in cells.items() if k[i] == v)
    ones, ratio = dict.fromkeys(cells, 1.0), dict.fromkeys(cells, 1 / sum(cells.values()))
    lifts = [{v: total(i, v, ones) ** mix.temper for v in sorted({k[i] for k in cells})} for i in range(3)]
    for _ in range(mix.sweeps):
        miss = dict.fromkeys(cells, 0.0)
        for i in range(3):
            sums = {v: total(i, v, ratio) for v in lifts[i]}
            by = {v: lifts[i][v] / sum(lifts[i].values()) / sums[v] if sums[v] > 0 else 0.0 for v in sums}
            ratio = {k: r * by[k[i]] for k, r in ratio.items()}
            miss = {k: max(m, abs(by[k[i]] - 1)) for k, m in miss.items()}
        if max(m for k, m in miss.items() if cells[k] and ratio[k]) <= mix.tolerance:
            break
    return ratio


def test_raking_is_plain_fitting_in_plans_that_do_not_nest(spark, monkeypatch):
    rng = random.Random(21)
    rows = {(f"s{rng.randint(0, 9)}", f"l{rng.randint(0, 4)}", "abc"[i % 3]): rng.randint(1, 500) for i in range(90)}
    rows |= {("s0", "l9", "a"): 0, ("s8", "l0", "b"): 0}
    cells = spark.createDataFrame([(*k, n) for k, n in rows.items()], "_m_source string, _m_lang string, _m_topic string, n long")
    joins, staged = [], mixing.stage

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return staged(df, name)

    monkeypatch.setattr(mixing, "stage", counted)
    for mix in (mixing.Mixture(), mixing.Mixture(temper=0.3, sweeps=2, tolerance=0.0), mixing.Mixture(sweeps=0)):
        joins.clear()
        got = mixing.rake(cells, mix)
        assert sorted(got.columns) == ["_m_lang", "_m_source", "_m_topic", "n", "ratio"]
        got, want = {tuple(r[f"_m_{a}"] for a in mixing.AXES): r for r in got.collect()}, plain_rake(rows, mix)
        assert {k: r.n for k, r in got.items()} == rows
        for k, r in got.items():
            assert r.ratio == pytest.approx(want[k], rel=1e-9), k
        # Three joins bring the shares, then a step is one join with its factors, however many steps went before.
        assert joins[0] <= 3 and max(joins[1:], default=0) <= 1, joins


def test_marginals_sum_what_is_expected(spark):
    rows = [("s0", "en", "a", 100, 0.5), ("s0", "de", "a", 50, 2.0), ("s1", "en", "b", 30, 0.0), (None, "en", "b", 20, 1.0)]
    cells = spark.createDataFrame(rows, "_m_source string, _m_lang string, _m_topic string, n long, p double")
    mix = mixing.Mixture({"lang": {"en": 0.25}})
    got = {(r.axis, r.value): r for r in mixing.marginals(cells, mix).collect()}
    assert set(got) == {("source", "s0"), ("source", "s1"), ("lang", "en"), ("lang", "de"), ("topic", "a"), ("topic", "b")}
    for k, expected in {("source", "s0"): 150, ("source", "s1"): 0, ("lang", "en"): 70, ("topic", "b"): 20}.items():
        assert got[k].expected == pytest.approx(expected / 170), k
    assert got["lang", "en"].wanted == 0.25 and got["lang", "de"].unmet == pytest.approx(0.75 - 100 / 170)


def test_mixing_samples_by_its_chances(spark):
    rng = random.Random(4)
    docs = frame(spark, [*[prose(rng, 30) for _ in range(1500)], "", None])
    out = mixing.mix_sources(docs.union(docs.where("doc_id < 3")), mixing.Mixture(budget=0.5)).collect()
    assert len(out) == 1505 and out[0].key == "x"
    kept = sum(r.tokens for r in out if r.sampled)
    assert kept == pytest.approx(0.5 * sum(r.tokens for r in out), rel=0.08)
    for i in range(3):  # equal rows share their fate
        assert len({r.sampled for r in out if r.doc_id == i}) == 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_meets_shares_beyond_what_rare_cells_have(spark):
    rows = [("s0", "en", "a", 90_000), ("s0", "de", "a", 6_000), ("s1", "en", "a", 3_000), ("s1", "en", "b", 600), ("s0", "de", "b", 400)]
    cells = spark.createDataFrame(rows, "_m_source string, _m_lang string, _m_topic string, n long")
    mix = mixing.Mixture({"topic": {"b": 0.04}}, budget=0.7)
    got = mixing.calibrate(mixing.rake(cells, mix), mix)
    assert sum(r.n * r.p for r in got.collect()) == pytest.approx(70_000, rel=1e-6)
    for r in mixing.marginals(got, mix).collect():
        assert r.expected == pytest.approx(r.wanted, rel=2e-3) and abs(r.unmet) < 2e-3, r
    # A source and a language that only occur together, with shares that contradict each other.
    odd = spark.createDataFrame([("s0", "en", "a", 100), ("s1", "de", "a", 100)], cells.schema)
    mix = mixing.Mixture({"source": {"s0": 0.5}, "lang": {"en": 0.8}})
    with pytest.warns(UserWarning, match="not met"):
        mixing.report(mixing.calibrate(mixing.rake(odd, mix), mix), mix)


def test_mixing_repeats_rare_documents(spark):
    rng = random.Random(14)
    data = [(i, prose(rng, 30), "en", "rare" if i < 20 else "src", 1, "x", "x", "x") for i in range(1000)] + [(5000, "", "en", "rare", 0, "x", "x", "x")]
    docs = spark.createDataFrame(data, SCHEMA)
    mixed = mixing.mix_sources(docs, mixing.Mixture({"source": {"rare": 0.2}}))
    out = {r.doc_id: r for r in mixed.collect()}
    assert all(r.sampled == (r.copies > 0) for r in out.values()) and out[5000].copies <= 1
    assert sum(out[i].copies for i in range(20)) == pytest.approx(140, abs=10)
    taken = Counter(r.doc_id for r in mixing.repeated(mixed, ["doc_id", "text"]).collect())
    assert taken == Counter({i: r.copies for i, r in out.items() if r.copies})
    assert sum(taken.values()) == pytest.approx(700, rel=0.08)


# ------------------------------------------------------------------ 4: toxicity
def test_folding():
    assert toxicity.fold("1D10T, ЅТUРІD! łos€r pathétic m0r0n$x") == " idiot stupid los€r pathetic moronsx "
    assert toxicity.fold("") == "  "


def test_toxicity_is_learned_and_held_out(spark):
    rng = random.Random(5)
    bad, texts, labels = ["vlorp", "snedge", "grumfil"], [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 200)).split()
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad).replace("o", rng.choice("o0о"))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    texts += ["", None, "what a trash can", "what trash"]
    docs = frame(spark, texts)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.rate(docs.union(docs.where("doc_id = 7")), marks).collect()}
    wrong = sum(got[i].predicted != t for i, t in labels if got[i].held_out)
    assert sum(got[i].held_out for i, _ in labels) > 150 and wrong <= 3
    assert got[900].score == got[901].score == 0 and got[902].predicted == 0 and got[903].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # Without labels the seeds decide.
    alone = {r.doc_id: r.predicted for r in toxicity.rate(docs, marks.limit(0)).collect()}
    assert alone[903] == 1 and alone[902] == 0 and sum(alone.values()) == 1
    assert toxicity.rate(docs.limit(0), marks.limit(0)).count() == 0


def plain_points(text, lexicon):
    words = toxicity.fold(text).split()
    excused = {j for phrase in lexicon.exceptions for i in range(len(words))
               if words[i : i + len(phrase.split())] == phrase.split() for j in range(i, i + len(phrase.split()))}
    hits = [lexicon.weights[w] for i, w in enumerate(words) if w in lexicon.weights and i not in excused]
    return (sum(hits) / (1 + math.log10(1 + len(words) / 10)) if hits else 0.0), len(hits)


def test_toxicity_points_match_a_plain_count():
    rng = random.Random(15)
    lexicon = toxicity.Lexicon({"bad": 2.0, "worse": 3.5, "can": 1.0}, ("bad can", "so bad", "can do worse"))
    automaton = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rng.choice(["bad", "worse", "can", "so", "do", "badly", "x", "B4D"]) for _ in range(rng.randint(0, 30)))
        got, want = toxicity.points(text, automaton), plain_points(text, lexicon)
        assert got[1] == want[1] and got[0] == pytest.approx(want[0])
    assert toxicity.points("so bad can do worse " * 50_000, automaton)[1] == 0


def test_toxicity_knows_whole_words_and_exceptions(spark):
    rng = random.Random(16)
    insults, texts, labels = ["pathetic", "worthless", "clown", "stupid", "disgusting", "scum", "idiot", "gromp"], [], []
    for i in range(1200):
        words = prose(rng, rng.randint(15, 150)).split()
        if i % 8 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        elif i % 40 == 1:
            words.insert(rng.randrange(len(words)), "gromp fish")
        texts.append(" ".join(words))
        labels.append((i, int(i % 8 == 0)))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    clean = ["It is worth following the path.", "A worthy path of stupendous worth.", "We saw a gromp fish.",
             "The pathologist thought the pathway was worthwhile.", "Scummy is no word here, nor is clownfish or idiotic grammar."]
    foul = ["you are an idiot", "What a GR0MP!", "those worthless clowns went home"]
    docs = frame(spark, [*texts, *clean, *foul])
    got = {r.doc_id: r for r in toxicity.rate(docs, marks).collect()}
    assert [got[1200 + i].predicted for i in range(len(clean) + len(foul))] == [0] * len(clean) + [1] * len(foul)
    alarms = sum(got[i].predicted for i, t in labels if not t)
    assert alarms <= 0.01 * len(labels) and sum(got[i].predicted for i, t in labels if t) >= 0.98 * 150


# ------------------------------------------------------------------ 5: near duplicates
def plain_classes(texts, p=neardup.NearDup()):
    def shingles(text):
        w = plain_words(text)
        n = min(p.words, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    df = Counter(s for c in sets.values() for s in c)

    def weight(s, tf):
        share = df[s] / len(sets)
        return tf * (1 if share * p.common <= 1 else p.floor + (1 - p.floor) * math.log(1 / share) / math.log(p.common))

    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations([i for i in sets if sets[i]], 2):
        x, y = sets[a], sets[b]
        least = sum(min(weight(s, x[s]), weight(s, y[s])) for s in x.keys() & y.keys())
        most = sum(weight(s, t) for c in (x, y) for s, t in c.items()) - least
        if least >= p.similarity * most - 1e-9:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(6)
    passage = prose(rng, 50, 5000)
    base = prose(rng, 150, 5000)
    texts = [f"{prose(rng, 60, 5000)} {passage}" for _ in range(40)]
    texts += [edited(rng, base, rng.randint(0, 8)) for _ in range(60)]  # a family, some of it too far apart
    texts += [base] * 5 + [base.upper() + " !"]
    for i in range(10):
        texts.append(edited(rng, texts[i], 2))
    texts += ["", None, "?!", "one", "one", "one two", "a b c d e", "a b c d e " * 30, "a b c d e " * 28]
    docs = frame(spark, texts).repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == plain_classes(texts)
    kept = neardup.keep_one(docs.union(docs.where("doc_id < 4"))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values())) and kept[0].score == "x"
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_shingle_frequencies_do_not_depend_on_the_layout(spark):
    p, n = neardup.NearDup(), 6400

    def text(i):
        # 112 of the first half and 18 of the second: too few there to be told of by a block of their own.
        return f"one two three four five u{i}" if i % (n // 2) < (112 if i < n // 2 else 18) else f"u{i} v{i}"

    rows = [(i, text(i)) for i in range(n)]
    weight = p.floor + (1 - p.floor) * math.log(n / 130) / math.log(p.common)
    for parts, some in ((2, rows), (2, sorted(rows, key=lambda r: r[0] % 97)), (1, rows)):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(some, parts), "doc_id long, text string")
        values, idf = neardup.common_shingles(docs, p)
        assert len(values) == 1 and idf[0] == pytest.approx(weight)
    # A shingle of one document counts too, where there are few of them.
    few = neardup.common_shingles(spark.createDataFrame([(i, f"u{i}") for i in range(10)], "doc_id long, text string"), p)
    assert len(few[0]) == 10 and few[1] == pytest.approx(p.floor + (1 - p.floor) * math.log(10) / math.log(p.common))


def test_consistent_weighted_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.sort(values[:250]), np.sort(values[50:])
    w = {int(v): float(x) for v, x in zip(values, rng.choice([1.0, 1.0, 0.8, 2.0, 5.0], 300), strict=True)}
    wa = np.array([w[int(v)] for v in a])
    wb = np.array([w[int(v)] * (2 if i % 3 == 0 else 1) for i, v in enumerate(b)])
    weights = [dict(zip(map(int, v), x, strict=True)) for v, x in ((a, wa), (b, wb))]
    keys = weights[0].keys() | weights[1].keys()
    least, most = (sum(f(weights[0].get(k, 0), weights[1].get(k, 0)) for k in keys) for f in (min, max))
    got = neardup.samples(np.concatenate((a, b)), np.concatenate((wa, wb)), np.array([0, len(a)]), 4000)
    assert (got[0] == got[1]).mean() == pytest.approx(least / most, abs=0.03)


# ------------------------------------------------------------------ 6: pages
PAGE = """<html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div id="main-menu">Home, News</div><div class="post-content"><h2>Title &amp; more</h2>
<p>First   paragraph,&nbsp;with <a href=x>link</a> &eacute;, long enough, to count.<p>Second one, left open, <b>bold<br>text, and so on.
<div class="share">Share</div><ul><li>one<li>two</ul><form><p>Mail <input></p></form></div>
<div id="comments"><p>Great post, love it, thanks, so much, really, yes, indeed, truly.</p></div>
<aside><p>Side, bar, text, very, very, long.</p></aside><div class="cookie-notice">Cookies, we use</div><footer>f</footer></body></html>"""


def test_pages(spark):
    want = ["Title & more", "First paragraph, with link é, long enough, to count.", "Second one, left open, bold text, and so on.", "one", "two"]
    assert pages.extract(PAGE).split("\n\n") == want
    article = "<article><h1>Head</h1><p><b>Lead<br><p>Body, of it.</article>"
    assert pages.extract(f"<nav><a>x</a></nav>{article}<footer>y") == "Head\n\nLead\n\nBody, of it."
    cases = [None, "", "plain", "<p>a<b>b</b><", "<!-- c --><div><span>x</span><br>y</div>", "<script>only", "<a><b></a></b></p>", PAGE]
    df = spark.createDataFrame([(i, "u", c, "x") for i, c in enumerate([*cases, PAGE])], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.extract_pages(df).collect()}
    assert [got[i].text for i in range(7)] == ["", "", "plain", "ab<", "x y", "", ""]
    assert got[7].text == got[8].text and got[7].n_chars == len(got[7].text)
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_pages_without_article_keep_what_is_beside_the_container():
    long = "<p>One, two, three, four, a paragraph that is long enough to count, and then some more of it.</p>" * 4
    body = [x for x in ["One, two, three, four, a paragraph that is long enough to count, and then some more of it."] * 4]
    page = f"""<body><nav><a href=/>Home</a></nav><h1><a href=x>Title</a></h1>Bare lead.<div class=wrap><h2>Sub</h2><div class=text>{long}</div>
<ul><li>first<li>second</ul><p>Short end.</p><blockquote>A quote</blockquote><table><tr><td>1<td>2</table><section><p>Aa.<p>Bb.</section>
<div><a href=1>Other page</a> <a href=2>Next one</a></div></div><footer>f</footer></body>"""
    want = ["Title", "Bare lead.", "Sub", *body, "first", "second", "Short end.", "A quote", "1 2", "Aa.", "Bb."]
    assert pages.extract(page).split("\n\n") == want
    # With an article element, what is beside it is still weighed.
    assert pages.extract(f"<div>Short note</div><article>{long}</article>").split("\n\n") == body


def test_pages_wrapped_by_what_is_mostly_outside():
    body = [f"Prose number {i}, which is of some length and ends here." for i in range(6)]
    inner = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in body)
    want = ["Title", *body]
    for page in (
        f"<body><form id=aspnetForm><input name=q><div>{inner}</div><button>Go</button></form></body>",
        f"<body><div class='page-sidebar-left'><div>{inner}</div><div class='sidebar'><p>{body[0] * 9}</p></div></div></body>",
        f"<article><header><h1>Title</h1></header>{''.join(f'<p>{x}</p>' for x in body)}</article>",
        f"<div>{inner}</div><form><p>{body[0]}</p></form><div class=comment-list>{'<p>' + body[1] * 99}</p></div>",
        f"<article>{inner}</article><form><p>{body[0] * 99}</p></form>",
    ):
        assert pages.extract(page).split("\n\n") == want, page
    assert pages.extract(f'<article>{inner}<p><a title="x>link</a> after</p></article>').split("\n\n") == [*want, "link after"]
    assert pages.extract(f"<article>{inner}<p><a title='a > b' rel=\"c\">link</a> after</p></article>").endswith("link after")


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "<div>" * 50_000 + "</section>" * 50_000 + "x", "<div><p>a, b</p>" * 50_000 + "x",
    "<li>" * 50_000 + "<td>" * 50_000 + "x", '<a title="y>' * 50_000 + "x", "<b>" * 50_000 + "<p>x" * 50_000,
])
def test_long_pages_take_time_in_proportion(page):
    started = time.monotonic()
    assert pages.extract(page).endswith("x")
    assert time.monotonic() - started < 20


def test_pages_nested_deeply():
    for tag in ("div", "span", "font", "a", "b"):
        assert pages.extract(f"<p>Head.</p>{f'<{tag}>' * 5000}deep text").split("\n\n")[-1] == "deep text"
    assert pages.extract("<div><span>" * 2500 + "x" + "</span></div>" * 2500) == "x"
    assert pages.extract("<span>" * 5000 + "<p>one<p>two").split("\n\n") == ["one", "two"]


# ------------------------------------------------------------------ 8: tokens
PIECES = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.2, "abc": -4.0, "c": -3.5, "▁abc": -5.0, "ä": -4.0}


def plain_count(text):
    total = 0
    for word in (text or "").split():
        word = tokens.SPACE + word
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            ways = [(best[end - 1][0] + (min(PIECES.values()) - 10) * n, best[end - 1][1] + n)]
            ways += [(best[s][0] + PIECES[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in PIECES]
            best[end] = max(ways, key=lambda w: (w[0], -w[1]))
        total += best[-1][1]
    return total


def test_token_counts(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcä✓", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["", None, "  ", "abc" * 3000, texts[0]]
    got = {r.doc_id: r for r in tokens.count_tokens(frame(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_pretokens, got[i].n_tokens) == (len((t or "").split()), plain_count(t)), i
    assert tokens.count_tokens(frame(spark, texts).limit(0), PIECES).count() == 0


# ------------------------------------------------------------------ the pipeline
def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    texts = [prose(rng, 120, 9000) for _ in range(200)]
    texts += [texts[0]] * 3 + [edited(rng, texts[1], 1), "too short", "x y " * 100, " ".join(f"{w}###" for w in prose(rng, 80).split())]
    item = prose(rng, 30, 9000)
    texts[5] = f"{prose(rng, 60, 9000)} {item} {prose(rng, 60, 9000)}"
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    assert set(range(200)) <= set(seen["quality_rules"]) and not {204, 205, 206} & set(seen["quality_rules"])
    assert set(seen["near_dedup"]) == set(range(200))
    cut = seen["decontamination"][5]
    assert item.split()[3:20] != [] and not set(plain_passages(cut.text, [(1, item)])[1]) and cut.n_chars == len(cut.text)
    assert all(seen["decontamination"][i].text == texts[i] for i in range(200) if i != 5)
    assert set(seen["mixing"]) < set(seen["decontamination"]) and set(seen["sharding"]) == set(seen["mixing"])
    assert {r.shard for r in seen["sharding"].values()} <= set(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.text, r.shard) for r in out.collect()} == {(r.doc_id, r.text, r.shard) for r in seen["sharding"].values()}
