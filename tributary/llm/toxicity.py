"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_batches

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
# Words with a weight before any label is seen, and phrases in which they insult nobody.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile", "bastard")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "pond scum", "idiot proof", "idiot light", "stupid good", "sore loser rule")

_GLYPHS = str.maketrans(HOMOGLYPHS)
_FOLD = {c: " " for c in map(chr, range(128)) if not c.isalnum()} | DIGITS
_ASCII = str.maketrans(_FOLD)
_GLYPH = re.compile("[%s]" % "".join(HOMOGLYPHS))
_SIGN = re.compile(r"(?<=[a-z0-9])[@$!|+](?=[a-z0-9])")
_REST = re.compile(r"[̀-ͯ]")


def fold(text: str) -> str:
    """Lower-case words without accents, look-alikes or substituted digits, one space around each.

    Signs stand for letters only inside a word. Letters of other scripts stay.
    """
    text = text.casefold()
    if not text.isascii():
        text = _GLYPH.sub(lambda m: HOMOGLYPHS[m[0]], text)
        text = _REST.sub("", unicodedata.normalize("NFKD", text))
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_ASCII).split())} "


@dataclass(frozen=True)
class Toxicity:
    """Parameters.

    `labels`: labelled rows that are used at most, the same ones each time. `terms`: size
    of the lexicon. `support`: share of the distinct toxic texts, 3 at least, that a term
    must occur in. `odds`: how many times more likely it has to be in toxic texts, outside
    exception phrases; `doubtful`: how many times for phrases around it to be looked at.
    `phrases`: exception phrases that are learned at most. `stems`: lengths of the word beginnings
    that may be terms, as compounds need them; such a stem begins at least `kin` different
    words of toxic texts, and none of them is in more than the share `chief` of the stem's
    texts. So the beginning of one insult, which clean words may share, is no term.
    """

    labels: int = 50_000
    terms: int = 5_000
    support: float = 0.005
    odds: float = 50.0
    doubtful: float = 2.0
    phrases: int = 5_000
    stems: tuple[int, ...] = (4, 5, 6)
    kin: int = 8
    chief: float = 0.5
    threshold: float = 0.3
    seed_weight: float = 4.0


@dataclass
class Lexicon:
    """Weights of words and of stems (`stem*`), exception phrases, and the score's middle."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    cutoff: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            key = f" {word[:-1]}" if word.endswith("*") else f" {word} "
            found.add_word(key, (len(key), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
        found.make_automaton()
        return found


def length_measure(words: int) -> float:
    """What a sum of weights is divided by: a longer text has more room for a chance match."""
    return 1 + math.log10(1 + words / 10)


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """(place, weight) of the words of a folded text that the lexicon knows and no exception phrase holds.

    A word has the highest weight of the terms it matches.
    """
    best: dict[int, tuple[float, int]] = {}
    excused = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight < 0:
            excused.append((start, end))
        elif start not in best or weight > best[start][0]:
            best[start] = (weight, end)
    if not excused:
        return [(s, w) for s, (w, _) in best.items()]
    # Both lists are walked once, by start; `reach` is the end of the phrases that have begun.
    excused.sort()
    left, at, reach = [], 0, -1
    for s, (w, e) in sorted(best.items()):
        while at < len(excused) and excused[at][0] <= s:
            reach = max(reach, excused[at][1])
            at += 1
        if e > reach:
            left.append((s, w))
    return left


def points(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """Sum of the weights of the words matched over the measure of length; and how many matched."""
    folded = fold(text)
    found = matches(folded, automaton)
    if not found:
        return 0.0, 0
    return sum(w for _, w in found) / length_measure(folded.count(" ") - 1), len(found)


def family(word: str) -> list[str]:
    """A word's inflected forms that stand for it: its plurals."""
    return [word + "s", word + "es"]


def labelled(docs: DataFrame, labels: DataFrame, p: Toxicity) -> DataFrame:
    """text, toxic of the training rows: at most `labels` distinct ids, by hash order.

    An id with several labels takes the highest; null labels are no labels.
    """
    chosen = stage(
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_l_id")).agg(F.max("toxic").cast("int").alias("_l_toxic"))
        .orderBy(F.xxhash64("_l_id"), "_l_id").limit(p.labels),
        "labels",
    )
    return docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_l_id")  # at most `labels` rows
    ).select(F.coalesce("text", F.lit("")).alias("text"), F.col("_l_toxic").alias("toxic"))


def _terms(text: str, stems: tuple[int, ...]) -> set[str]:
    words = {w for w in fold(text).split() if len(w) >= 3}
    return words | {f"{w[:n]}*" for w in words for n in stems if len(w) > n}


def _pairs(text: str, words: set[str]) -> set[str]:
    """Phrases of two words, of which one is in `words`."""
    run = fold(text).split()
    return {f"{a} {b}" for a, b in zip(run, run[1:]) if a in words or b in words}


def _outside(text: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Words of the automaton that occur outside its exception phrases."""
    folded = fold(text)
    return {folded[s + 1 : folded.index(" ", s + 1)] for s, _ in matches(folded, automaton)}


def _counted(rows: DataFrame, terms: Callable[[str], set[str]]) -> DataFrame:
    """term, toxic, clean: distinct training texts of each label that hold a term, added up by task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = [*toxic.keys() | clean.keys()]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()),
                 pa.array([clean[t] for t in names], pa.int64())], names=["term", "toxic", "clean"],
            )

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(terms(text))
                if len(toxic) + len(clean) > 300_000:
                    yield flush()
                    toxic.clear()
                    clean.clear()
        yield flush()

    return map_batches(rows, count, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def learn(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Lexicon:
    """A lexicon from labelled rows: log odds of words and stems, exception phrases, and the cutoff.

    Equal texts count once. Words that toxic texts have rather more often are candidates. A
    phrase of a candidate and a word beside it is an exception if clean texts have it more
    often than toxic ones. What a candidate weighs is counted outside the exceptions, and
    it stays if that is far more often in toxic texts. Plurals of a term that no clean
    text has are terms too. The driver gets at most `terms` words, `terms` stems and `phrases` phrases.
    """
    rows = stage(labelled(docs, labels, p).dropDuplicates(["text"]), "training")
    totals = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = sum(n for t, n in totals.items() if t), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({w: p.seed_weight for s in SEEDS for w in (s, *family(s))})
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    least = max(3.0, p.support * n_toxic)

    terms = stage(_counted(rows, lambda text: _terms(text, p.stems)).where("toxic > 0").withColumn("weight", odds), "terms")
    stem = F.col("term").endswith("*")
    first = [F.desc(F.col("weight") * F.col("toxic")), F.col("term")]
    words = terms.where(~stem & (F.col("toxic") >= least) & (F.col("weight") >= math.log(p.doubtful)))
    candidates = {r.term for r in words.orderBy(*first).limit(p.terms).collect()} | set(SEEDS)
    strong = terms.where(stem & (F.col("toxic") >= least) & (F.col("weight") >= math.log(p.odds)))
    kin = (
        terms.where(~stem)
        .select("toxic", F.explode(F.array(*[
            F.when(F.char_length("term") > n, F.concat(F.left("term", F.lit(n)), F.lit("*"))) for n in p.stems
        ])).alias("stem"))
        .groupBy("stem").agg(F.count("*").alias("words"), F.max("toxic").alias("chief"))
    )
    stems = {
        r.term: r.weight
        for r in strong.join(kin, F.col("term") == F.col("stem"))
        .where((F.col("words") >= p.kin) & (F.col("chief") <= p.chief * F.col("toxic")))
        .orderBy(*first).limit(p.terms).collect()
    }

    phrases = _counted(rows, lambda text: _pairs(text, candidates)).withColumn("weight", odds)
    learned = phrases.where((F.col("clean") >= 3) & (F.col("weight") < 0)).orderBy(F.desc("clean"), "term").limit(p.phrases)
    exceptions = (*EXCEPTIONS, *(r.term for r in learned.collect()))

    probe = Lexicon({w: 1.0 for c in candidates for w in (c, *family(c))}, exceptions)

    def outside() -> Callable[[str], set[str]]:
        built: list[ahocorasick.Automaton] = []

        def known(text: str) -> set[str]:
            if not built:
                built.append(probe.automaton())
            return _outside(text, built[0])

        return known

    counts = {r.term: r for r in _counted(rows, outside()).withColumn("weight", odds).collect()}  # candidates and plurals only
    weights: dict[str, float] = {}
    for word in sorted(candidates):
        r = counts.get(word)
        if r is not None and r.toxic >= least and r.weight >= math.log(p.odds):
            weights[word] = r.weight
        elif word in SEEDS and (r is None or not r.clean):
            weights[word] = p.seed_weight
    for word, weight in list(weights.items()):
        for form in family(word):
            if form not in candidates and (form not in counts or not counts[form].clean):
                weights[form] = weight
    needed = tuple(x for x in exceptions if x in EXCEPTIONS or any(w in weights for w in x.split()))
    lexicon = Lexicon(weights | stems, needed)
    # Rows of each tenth of a point: at most a few thousand numbers, whatever the input.
    table = score(rows.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic"), lexicon, p, ["toxic"]).groupBy(
        F.least(F.floor(F.col("points") * 10), F.lit(1000)).alias("b")
    ).agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).collect()
    # One insult makes a text of ten words toxic, whatever the training texts are like.
    lexicon.cutoff = min(best_cutoff([(r.b, r.t, r.n) for r in table], n_toxic), p.seed_weight / length_measure(10))
    return lexicon


def best_cutoff(rows: list[tuple[int, int, int]], n_toxic: int) -> float:
    """The points from which texts count as toxic for the highest F1; the middle of the best range."""
    best, at, hit, named, upper = -1.0, 2.0, 0, 0, None
    for b, t, n in sorted(rows, reverse=True):
        if b <= 0:
            # Below the lowest bucket with points, nothing has matched.
            break
        hit, named, upper = hit + t, named + n, b
        f1 = 2 * hit / (named + n_toxic)
        if f1 > best:
            best, at = f1, upper / 10
    return max(at * 0.75, 0.5)


def score(docs: DataFrame, lexicon: Lexicon, p: Toxicity, keep: list[str]) -> DataFrame:
    """Columns `keep` with doc_id, points, matches and score in 0 to 1; at the cutoff it is the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.cutoff))
    source = docs.select(*keep, "doc_id", "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    middle = (1 - p.threshold) / p.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(*shared.value)
        automaton, cutoff = known.automaton(), known.cutoff
        for batch in batches:
            got = [points(t, automaton) if t else (0.0, 0) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1], pa.array([x for x, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64()),
                    pa.array([x / (x + cutoff * middle) for x, _ in got], pa.float64()),
                ],
                names=[*batch.schema.names[:-1], "points", "matches", "score"],
            )

    return map_batches(source, run, f"{fields}, points double, matches long, score double")


def held_out() -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score, predicted, points and matches for every row of `docs`.

    The lexicon is learned from labelled rows that aren't held out. Null and empty texts
    have score 0; a null id is not held out. Without labels, the seeds alone decide.
    """
    lexicon = learn(docs, labels.where(~held_out()), p)
    return score(docs, lexicon, p, []).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"),
        "points", "matches",
    )
