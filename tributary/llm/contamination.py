"""Benchmark passages found with an FM-index of each shard of the training text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, map_batches, text_or_empty, utf8_values, words_of

WINDOW = 10
# Text of the benchmark that is searched for at a time.
BLOCK_BYTES = 8 << 20
# An index is built when a shard holds so many words of the benchmark or bytes of text.
SHARD_WORDS = 1 << 20
SHARD_BYTES = 32 << 20
SAMPLE = 8


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, (alphabet - 1).bit_length())
        self.levels, self.zeros = [], []
        current = symbols
        for level in reversed(range(self.bits)):
            ones = (current >> level) & 1 != 0
            self.levels.append(BitRank(ones))
            self.zeros.append(int(len(current) - ones.sum()))
            current = np.concatenate((current[~ones], current[ones]))
        self.first = np.zeros(alphabet, np.int64)
        self.first = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(reversed(range(self.bits)), self.levels, self.zeros, strict=True):
            r = ones.rank(i)
            i = np.where((symbols >> level) & 1 != 0, zeros + r, i - r)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbols, i) - self.first[symbols]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each occurs before its place."""
        symbols = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            one, r = ones.get(i), ones.rank(i)
            symbols = symbols * 2 + one
            i = np.where(one, zeros + r, i - r)
        return symbols, i - self.first[symbols]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of `seq`, which ends with 0. Each 0 is a symbol of its own.

    Ranks are doubled in reach until no two are equal; only suffixes that still share a
    rank are sorted again. No two suffixes agree beyond a 0, so the longest run between
    zeros limits the number of rounds.
    """
    stops = seq == 0
    rank = np.where(stops, np.cumsum(stops) - 1, seq.astype(np.int64) + int(stops.sum()))
    order = np.argsort(rank, kind="stable")
    slots, members, keys, reach = np.arange(len(seq)), order, rank[order], 1
    rank = np.empty(len(seq), np.int64)
    while len(members):
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(keys)))
        order[slots] = members
        rank[members] = np.repeat(slots[start], size)
        shared = np.repeat(size > 1, size)
        slots, members = slots[shared], members[shared]
        if not len(members):
            break
        key = (rank[members] << 32) | rank[members + reach]
        by = np.argsort(key, kind="stable")
        members, keys = members[by], key[by]
        reach *= 2
    return order


class FMIndex:
    """Backward search and location in a sequence of word numbers; 0 separates runs."""

    def __init__(self, seq: np.ndarray, alphabet: int, sample: int = SAMPLE):
        places = suffix_array(seq)
        before = seq[places - 1].astype(np.int64)
        counts = np.bincount(seq, minlength=alphabet)
        self.start = np.concatenate(([0], np.cumsum(counts)))
        self.last = WaveletMatrix(before, alphabet)
        # Sampled: every `sample`-th place, and the first of each run, before which is a 0.
        kept = (places % sample == 0) | (before == 0)
        self.marks, self.samples = BitRank(kept), places[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the index that begin with each phrase (rows of words), from and to."""
        low = self.start[phrases[:, -1]]
        high = self.start[phrases[:, -1] + 1]
        for column in reversed(range(phrases.shape[1] - 1)):
            c = phrases[:, column].astype(np.int64)
            low = self.start[c] + self.last.rank(c, low)
            high = self.start[c] + self.last.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence of rows, by steps back to the next sampled row."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.marks.get(rows)
            out[todo[done]] = self.samples[self.marks.rank(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                c, r = self.last.access(rows)
                rows = self.start[c] + r
            steps += 1
        return out


@dataclass
class Phrases:
    """Windows of benchmark items as numbers of words; 0 is any other word."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    # Items of each window of a length: where they start, and the ids one after the other.
    owners: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> Phrases:
        out, found = Phrases(), {}
        for item, text in items:
            words = words_of((text or "").encode())
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        for size, windows in found.items():
            out.windows[size] = np.array(list(windows), np.int64)
            named = [sorted(x for x in s if x is not None) for s in windows.values()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in named])))
            out.owners[size] = ends, np.array([x for s in named for x in s], np.int64)
        return out


@dataclass
class Shard:
    """Runs of benchmark words of some documents, long enough for the shortest window."""

    phrases: Phrases
    least: int
    runs: list[np.ndarray] = field(default_factory=list)
    docs: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    size: int = 0

    def add(self, texts: list[bytes | None]) -> None:
        number, rows = self.phrases.vocabulary.get, []
        for text in texts:
            words = words_of(text or b"")
            self.counts.append(len(words))
            ids = np.zeros(len(words) + 1, np.int32)  # a 0 ends a document
            ids[:-1] = np.fromiter(map(number, words, repeat(0)), np.int32, len(words))
            rows.append(ids)
        if not rows:
            return
        ids = np.concatenate(rows)
        sizes = np.array([len(x) for x in rows])
        known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
        turn = np.diff(known)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return
        # Each run with the word after it, which is none of the benchmark's: a 0.
        lengths = ends - starts + 1
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        doc = np.repeat(np.arange(len(rows)), sizes)[at]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.runs.append(ids[at])
        self.docs.append(doc + len(self.counts) - len(rows))
        self.places.append(at - first[doc])
        self.size += len(at)

    def search(self) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
        """Merged spans of hit words and the items found, by document with any."""
        if not self.size:
            return {}
        seq, docs, places = map(np.concatenate, (self.runs, self.docs, self.places))
        index = FMIndex(seq, len(self.phrases.vocabulary) + 1)
        edge, pairs = np.zeros(len(seq) + 1, np.int64), []
        for size, windows in self.phrases.windows.items():
            low, high = index.ranges(windows)
            n = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            at = index.locate(rows)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            ends, ids = self.phrases.owners[size]
            seen = np.unique(docs[at] * len(windows) + np.repeat(np.arange(len(windows)), n))
            doc, window = seen // len(windows), seen % len(windows)
            many = np.diff(ends)[window]
            which = np.repeat(ends[window] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            pairs.append(np.stack((np.repeat(doc, many), ids[which])))
        hit = np.cumsum(edge[:-1]) > 0
        turn = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        out: dict[int, tuple[list[tuple[int, int]], list[int]]] = {}
        for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
            out.setdefault(int(docs[s]), ([], []))[0].append((int(places[s]), int(places[e - 1]) + 1))
        for doc, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist() if pairs else ():
            out[doc][1].append(item)
        return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : places[s][0]])
        done = places[e - 1][1]
    return b"".join([*out, text[done:]]).decode()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ADDED = ["n_words", "spans", "items"]
_ADDED = "n_words long, spans array<struct<start:long,end:long>>, items array<long>"
Found = tuple[list[tuple[int, int]], list[int]]


def unite(a: Found, b: Found) -> Found:
    """Overlapping and touching spans as one, and the items of both."""
    spans: list[tuple[int, int]] = []
    for s, e in sorted(a[0] + b[0]):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans, sorted({*a[1], *b[1]})


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def search(docs: DataFrame, phrases: Phrases, keep: list[str], earlier: bool, carry: bool) -> DataFrame:
    """Columns `keep` of `docs` with n_words, spans and items, and with the text if `carry`.

    The documents of a partition are taken in shards of bounded size. Words that no
    benchmark item has, and runs of known words shorter than any window, can't be part of
    an occurrence; the index of a shard holds the other runs. Frequent passages are
    many places of one row range, so a shard's memory doesn't depend on them. If
    `earlier`, `docs` has what another search found, which is united with this one's.
    """
    shared = docs.sparkSession.sparkContext.broadcast((phrases.vocabulary, phrases.windows, phrases.owners))
    wide = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Phrases(*shared.value)
        least = min(known.windows, default=1)

        def result(held: list[pa.RecordBatch], shard: Shard) -> Iterator[pa.RecordBatch]:
            found, at = shard.search(), 0
            for batch in held:
                rows = [found.get(i, ([], [])) for i in range(at, at + batch.num_rows)]
                counts = shard.counts[at : at + batch.num_rows]
                at += batch.num_rows
                if earlier:
                    old = zip(batch.column(wide + 1).to_pylist(), batch.column(wide + 2).to_pylist(), strict=True)
                    rows = [unite(r, ([(x["start"], x["end"]) for x in s], i)) for r, (s, i) in zip(rows, old, strict=True)]
                columns = [
                    *batch.columns[:wide], pa.array(counts, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in r[0]] for r in rows], _SPANS),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    *([batch.column(batch.num_columns - 1)] if carry else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:wide], *ADDED, *["text"] * carry])

        held, shard, size = [], Shard(known, least), 0
        for batch in batches:
            shard.add(utf8_values(batch.column(batch.num_columns - 1)))
            held.append(batch if carry else batch.select(range(batch.num_columns - 1)))
            size += batch.nbytes
            if shard.size >= SHARD_WORDS or size >= SHARD_BYTES:
                yield from result(held, shard)
                held, shard, size = [], Shard(known, least), 0
        yield from result(held, shard)

    source = docs.select(*keep, *(ADDED if earlier else []), "text")
    return map_batches(source, run, f"{_schema(docs, keep)}, {_ADDED}" + ", text string" * carry)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about `block_bytes` of text: what one pass searches for."""
    size = benchmark.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in part.collect()]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], carry: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of `docs`: columns `keep`, n_words, merged `spans` of words, `items`.

    Null and empty texts have no words; items without words occur nowhere; items
    without an id mark words but aren't listed. A benchmark beyond `block_bytes` is
    searched for block by block, each search adding to what the one before found; rows
    never move. `keep` must not name n_words, spans, items or text.
    """
    blocks = benchmark_blocks(benchmark, block_bytes)
    items, earlier = next(blocks), False
    for more in blocks:
        docs = search(docs, Phrases.of(items), keep, earlier, True)
        items, earlier = more, True
    return search(docs, Phrases.of(items), keep, earlier, carry)


def remove_passages(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `docs` with the passages cut from `text`.

    Texts in which nothing is found stay as they are; those with no word left go.
    """
    keep = [c for c in columns if c != "text"]
    found = find_passages(docs, benchmark, keep, carry=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(utf8_values(batch.column("text")), batch.column("spans").to_pylist(), strict=True)
            texts = [
                cut(t, [(x["start"], x["end"]) for x in s]) if s else None if t is None else t.decode() for t, s in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"]
            )

    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    left = found.where((F.size("spans") == 0) | (hit < F.col("n_words")))
    return map_batches(left, run, f"{_schema(docs, keep)}, text string").select(*columns)


def with_sizes(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars counted from the text, null where that is null."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))
