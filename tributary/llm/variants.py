"""Operator 11: spelling variants of words, found with a bit-sliced position index.

The vocabulary is every run of Latin letters that is long and frequent enough. Two words are near
if one inserted, deleted or replaced code point turns one into the other. A rare word's form is its
most frequent near word, a root is the end of the chain of forms.

The index holds one bitset over the words of a unit per (position, letter). A query word walks
through its letters once; word-parallel recurrences keep the set of words that agree so far and the
sets of those that agree but for one replaced letter, one letter more or one letter less. The latter
two look at the positions shifted by one. Words in a unit are numbered by falling frequency, so the
lowest bit of a result is the best near word and its popcount the number of near words: no pair of
words is ever written down.

A unit is a bucket: words of one length and the next that share the first half of the shorter's
letters, or its second half. One error leaves one half intact, so every near pair meets in a bucket,
and it is counted in the bucket of its second half only if the first halves differ. A bucket beyond
``unit_words`` is cut into slices by a hash, and each pair of slices is a unit.

Null texts hold no words, a null id is the empty string, an empty table gives no rows. Repeated
documents count again. Other columns are ignored, so their names may clash with anything here.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_batches, utf8_values

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, TIMES = 6, 5, 5
DAMAGE = 199
UNIT_WORDS = 2048
# Distinct words a task sums up before it passes them on: bounds its memory only.
HELD_WORDS = 1 << 19
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ------------------------------------------------------------------ vocabulary
def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int = DAMAGE,
) -> DataFrame:
    """(word, n): runs of letters with A-Z folded, of ``min_chars`` or more, found ``min_count`` times or more.

    If ``damage`` divides the checksum h of ``<id>:<run>``, the run loses its code point h % length.
    0 damages nothing.
    """
    run = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True):
                if not text:
                    continue
                runs = Counter(run.findall(text.translate(_FOLD).decode("utf-8", "replace")))
                seed = zlib.crc32(f"{key}:".encode())
                for word, n in runs.items():
                    if damage:
                        h = zlib.crc32(word.encode(), seed)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key")
    parts = map_batches(docs.select(ids, F.col(text_col).alias("text")), count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------ index of one unit
class PositionIndex:
    """Bitsets per (position, letter) over words of ``size`` and ``size + 1`` letters."""

    def __init__(self, words: list[str], size: int) -> None:
        self.size, self.every = size, (1 << len(words)) - 1
        self.at: list[dict[str, int]] = [{} for _ in range(size + 1)]
        self.longer = 0
        for i, word in enumerate(words):
            bit = 1 << i
            for letters, c in zip(self.at, word):
                letters[c] = letters.get(c, 0) | bit
            if len(word) > size:
                self.longer |= bit
        self.shorter = self.every ^ self.longer

    def near(self, word: str) -> tuple[int, int]:
        """Words with exactly one error; and those that share the first half of the shorter word."""
        half = self.size // 2
        same, exact, extra, other, missing = self.every, self.every, 0, 0, 0
        before: dict[str, int] = {}
        for p, c in enumerate(word):
            here = self.at[p].get(c, 0)
            if len(word) == self.size:
                extra = (extra | exact) & self.at[p + 1].get(c, 0)
                other = (other & here) | (exact ^ (exact & here))
            else:
                missing = (missing & before.get(c, 0)) | exact
            exact &= here
            before = self.at[p]
            if p + 1 == half:
                same = exact
        if len(word) == self.size:
            return (other & self.shorter) | ((extra | exact) & self.longer), same
        return missing & self.shorter, same


def _unit(rows: list[tuple[str, int, int]], size: int, tail: bool, split: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best, the best) for the words of one unit; rows: (word, n, slice)."""
    rows.sort(key=lambda r: (-r[1], r[0]))
    index = PositionIndex([r[0] for r in rows], size)
    slices: dict[int, int] = {}
    for i, r in enumerate(rows):
        slices[r[2]] = slices.get(r[2], 0) | 1 << i
    for word, _, own in rows:
        found, same = index.near(word)
        if tail:
            found &= ~same
        if split:
            found &= ~slices[own]
        if found:
            n, best = rows[(found & -found).bit_length() - 1][1::-1]
            yield word, found.bit_count(), n, best


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[tuple[str, int, int, str]] = []
    # bucket, first slice, second slice, size, tail, word, n, own slice
    for (_, a, b), unit in groupby(rows(), itemgetter(0, 1, 2)):
        members = list(unit)
        if len(members) > 1:
            out += _unit([r[5:8] for r in members], members[0][3], members[0][4], a != b)
        if len(out) > 20_000:
            yield _found(out)
            out = []
    if out:
        yield _found(out)


def _found(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    words, counts, ns, best = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(ns, pa.int64()), pa.array(best, pa.string())],
        ["word", "n_near", "best_n", "best"],
    )


def near_words(words: DataFrame, unit_words: int = UNIT_WORDS, min_chars: int = 1) -> DataFrame:
    """(word, n_near, form, form_n) of every word of (word, n) with a near word: how many, and the most frequent.

    Ties go to the word that is smaller in code-point order. No word is shorter than ``min_chars``.
    """
    length = F.length("word")
    size = F.explode(F.array(length, length - 1)).alias("size")
    first, second = F.expr("left(word, size div 2)"), F.expr("right(word, size - size div 2)")
    sides = F.explode(F.array(F.struct(F.lit(False).alias("tail"), first.alias("part")), F.struct(F.lit(True).alias("tail"), second.alias("part"))))
    dealt = (
        words.select("word", "n", size).where(F.col("size") >= min_chars).select("word", "n", "size", sides.alias("side"))
        .select("word", "n", "size", "side.tail", F.concat_ws(":", "size", F.col("side.tail").cast("int"), "side.part").alias("bucket"))
    )
    # Only buckets with more words than a unit takes: a small part of the table.
    large = (
        dealt.groupBy("bucket").count().where(F.col("count") > unit_words)
        .select("bucket", F.ceil(F.col("count") / unit_words).cast("int").alias("slices"))
    )
    slices = F.coalesce("slices", F.lit(1))
    units = (
        dealt.join(large, "bucket", "left")
        .withColumn("own", F.pmod(F.xxhash64("word"), slices).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), slices - 1)))
        .select(
            "bucket", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "size", "tail", "word", "n", "own"
        )
    )
    # A set number of tasks: adaptive execution would merge them by bytes, but the work here is in the bits.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = map_batches(
        units.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b"), _search,
        "word string, n_near long, best_n long, best string",
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (
        met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
        .select("word", "n_near", F.col("b.word").alias("form"), (-F.col("b.n")).alias("form_n"))
    )


# ------------------------------------------------------------------ forms and roots
def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain in (word, form), by doubling the steps.

    The count grows along a chain by a factor, so it is short and has no cycle.
    """
    up = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if up.join(on, "root", "left_semi").isEmpty():
            return up
        up = stage(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT, times: int = TIMES, damage: int = DAMAGE, unit_words: int = UNIT_WORDS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word if it is ``times`` as frequent or more, else null.
    """
    words = stage(count_words(docs, id_col, text_col, min_chars, min_count, damage), "words")
    is_form = F.col("form_n") >= F.col("n") * times
    judged = stage(
        words.join(near_words(words, unit_words, min_chars), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = roots_of(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
