"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.entities import connected_components
from ..session import stage
from .common import map_batches, mix64, utf8_values, words_of


# Bits of a sketch, a multiple of 64.
SKETCH = 1024
WORDS = [f"s{i}" for i in range(SKETCH // 64)]
# Shingles of compared texts that a task remembers.
REMEMBERED = 2_000_000


@dataclass(frozen=True)
class NearDup:
    """Parameters.

    A shingle in fewer than 1/`common` of the documents has the full weight; beyond, the
    weight falls with the logarithm of the share, from 1 to `floor`. The floor is high
    because the shingles of a large family of copies are frequent for the sole reason
    that the family is large: at 0.8, documents that share 0.834 of their shingles stay
    linked, however frequent these are.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    common: int = 64
    floor: float = 0.8
    # Bits of 64 by which samples of a pair may differ before it is compared. Of a pair at
    # 0.8, each bit differs with a chance of 0.1: more than 20 of 64 do in 1 of 10^6 pairs.
    differ: int = 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; a shorter text is one shingle, an empty one has none."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = mix64(out ^ h[i : i + len(out)]) if i else mix64(h[: len(out)])
    return out


def common_shingles(docs: DataFrame, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and IDF factors of the shingles in more than 1/`common` of all documents.

    Frequencies are exact, whatever the files' layout. A first pass names candidates: each block of a
    partition emits what reaches a share of 1/(2 `common`) in it, so a sum over all blocks lacks at most
    that share of the documents, and every shingle frequent enough has a sum beyond it. A second pass
    counts the candidates in all documents. There are at most 2 `common` times as many candidates as a
    document has shingles on average, whatever the number of documents: that bounds what reaches the driver.
    """
    none, total, size = (np.zeros(0, np.uint64), np.zeros(0)), docs.count(), p.words

    def batch_of(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "n"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n, seen = WordHashes(), [], 0, 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts * (2 * p.common) > n
            return batch_of(values[many], counts[many])

        for batch in batches:
            for text in utf8_values(batch.column(0)):
                held.append(np.unique(shingles(words_of(text or b""), hashes, size)))
                n, seen = n + 1, seen + len(held[-1])
                # The last block of a partition may be small and emit more; it stays below this size.
                if n >= 32 * p.common and seen >= 1 << 19:
                    yield flush()
                    held, n, seen = [], 0, 0
        if held:
            yield flush()

    def summed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], share: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles, sorted, and their sums where these are beyond 1/`share` of the documents."""
        sums = map_batches(docs.select("text"), fn, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        found = sums.where(F.col("n") * share > total).toPandas()
        values = found["shingle"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(values)
        return values[by], found["n"].to_numpy(np.int64)[by]

    candidates = summed(often, 2 * p.common)[0] if total else none[0]
    if not len(candidates):
        return none
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted = WordHashes(), shared.value
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for text in utf8_values(batch.column(0)):
                values = np.unique(shingles(words_of(text or b""), hashes, size))
                at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
                counts[at[wanted[at] == values]] += 1
        yield batch_of(wanted[counts > 0], counts[counts > 0])

    values, n = summed(exact, p.common)
    return values, p.floor + (1 - p.floor) * np.log(total / n) / np.log(p.common)


def weighted(values: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, with the weight TF x IDF factor of each."""
    values, tf = np.unique(values, return_counts=True)
    weights = tf.astype(np.float64)
    if len(common[0]) and len(values):
        at = np.minimum(np.searchsorted(common[0], values), len(common[0]) - 1)
        same = common[0][at] == values
        weights[same] *= common[1][at[same]]
    return values, weights


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def samples(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted samples of several texts: one row per text.

    For shingle s and sample k, the method draws r and c from Gamma(2, 1) and b from the
    unit interval, takes t = floor(ln w / r + b) and y = exp(r (t - b)), and keeps the (s, t)
    with the least a = c / (y e^r). At w = 1, a is exponential and t is 0. So the value a
    has at w = 1 is drawn first, from the hash of s and k, and r, c and b from their laws
    given that value, which only shingles with another weight need:
    c = a1 + Exp(1), z = ln(c / a1), r = z + Exp(1), b = 1 - z / r.
    `starts` are the texts' first places; texts without shingles may not be among them.
    """
    out = np.empty((len(starts), n), np.uint64)
    other = np.flatnonzero(weights != 1)
    text = np.searchsorted(starts, other, side="right") - 1
    logs = np.log(weights[other])
    unit = np.ones(len(values), bool)
    unit[other] = False
    heavy, most = values[other], np.uint64(0xFFFFFFFFFFFFFFFF)
    draws = np.empty_like(values)
    seeds = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(n):
        odd, shift = seeds[k] | np.uint64(1), seeds[k] >> np.uint64(1)
        np.multiply(values, odd, out=draws)
        np.bitwise_xor(draws, shift, out=draws)
        if not len(other):
            out[:, k] = mix64(np.minimum.reduceat(draws, starts))
            continue
        mine = draws[other]
        draws[other] = most
        least = np.minimum.reduceat(draws, starts)
        a = np.where(least == most, np.inf, -np.log1p(-np.minimum(_unit(least), 1 - 2.0**-53)))
        a1 = -np.log1p(-_unit(mine))
        e = mix64(heavy ^ shift)
        c = a1 - np.log(_unit(e))
        z = np.log(c / a1)
        r = z - np.log(_unit(mix64(e)))
        t = np.floor(logs / r + 1 - z / r)
        value = c * np.exp(-r * (t + z / r))
        mark = mix64(mine ^ mix64(t.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        mark = np.where(t == 0, mix64(mine), mark)
        by = np.lexsort((mark, value, text))
        firsts = by[np.concatenate(([True], text[by][1:] != text[by][:-1]))]
        got = mix64(least)
        better = value[firsts] < a[text[firsts]]
        got[text[firsts[better]]] = mark[firsts[better]]
        out[:, k] = got
    return out


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The odd sketch of each text: the parity of its shingles in each of `SKETCH` places.

    The exclusive or of two sketches has at most as many ones as there are shingles that
    only one of the texts has.
    """
    text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    place = (values >> np.uint64(17)).astype(np.int64) % SKETCH
    odd = np.bincount(text * SKETCH + place, minlength=len(starts) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(starts), SKETCH), axis=1).view(np.int64)


def signatures(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], p: NearDup) -> DataFrame:
    """doc_id, the text's hash, the key of its words, band keys, a bit of each sample,
    the sum and the least of its shingles' weights, and its sketch.

    All but doc_id and the text's hash are null for texts without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = "doc_id long, text_hash long, key binary, bands array<long>, bits long, weight double, lightest double, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hashes = shared.value, WordHashes()
        for batch in batches:
            texts = utf8_values(batch.column("text"))
            for first in range(0, len(texts), 64):
                part = texts[first : first + 64]
                keys, sets = [], []
                for text in part:
                    words = words_of(text or b"")
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    if words:
                        sets.append(weighted(shingles(words, hashes, p.words), frequent))
                bands: list = [None] * len(part)
                bits: list = [None] * len(part)
                sums: list = [None] * len(part)
                least: list = [None] * len(part)
                odd: list = [None] * len(part)
                if sets:
                    starts = np.cumsum([0, *[len(v) for v, _ in sets]])[:-1]
                    drawn = sketches(np.concatenate([v for v, _ in sets]), starts).tolist()
                    got = samples(np.concatenate([v for v, _ in sets]), np.concatenate([w for _, w in sets]), starts, p.samples)
                    banded = np.zeros((len(sets), p.bands), np.uint64)
                    for row in range(p.rows):
                        banded = mix64(banded ^ got[:, row :: p.rows])
                    packed = np.packbits((got & np.uint64(1)).astype(np.uint8)[:, :64], axis=1, bitorder="little")
                    words64 = np.zeros((len(sets), 8), np.uint8)
                    words64[:, : packed.shape[1]] = packed
                    at = [i for i, k in enumerate(keys) if k is not None]
                    rows = zip(at, banded.view(np.int64).tolist(), words64.view(np.int64)[:, 0].tolist(), sets, drawn, strict=True)
                    for i, b, w, (_, weights), x in rows:
                        bands[i], bits[i], odd[i] = b, w, x
                        sums[i], least[i] = float(weights.sum()), float(weights.min())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(part)), batch.column("text_hash").slice(first, len(part)),
                        pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.int64()),
                        pa.array(sums, pa.float64()), pa.array(least, pa.float64()), pa.array(odd, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "key", "bands", "bits", "weight", "lightest", "sketch"],
                )

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, schema)


def _possible(p: NearDup) -> Column:
    """Whether two nodes can be similar enough, by their samples' bits and their sketches.

    At a similarity t, the weights that only one of the texts has add to at most
    (1 - t) / (1 + t) of all weights; each shingle among them weighs as much as the lightest
    of both texts at least, and the sketches differ in no more places than there are such
    shingles. So the sketches never rule out a link.
    """
    bits = F.bit_count(F.col("bits").bitwiseXOR(F.col("o_bits"))) <= p.differ
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"o_{w}"))) for w in WORDS])
    share = (1 - p.similarity) / (1 + p.similarity)
    lightest = F.least("lightest", "o_lightest")
    return bits & (apart * lightest <= (F.col("weight") + F.col("o_weight")) * share + 1e-6)


def _first_bucket() -> Column:
    """Whether the band is the first in which both nodes have the same bucket."""
    same = F.zip_with("bands", "o_bands", lambda a, b: a == b)
    return F.array_position(same, F.lit(True)) == F.col("band") + 1


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, common: tuple[np.ndarray, np.ndarray], p: NearDup) -> DataFrame:
    """The pairs (hi, lo) of keys whose weighted Jaccard similarity is high enough.

    Only texts that take part move, one for each key. A task remembers the shingles of
    texts it has seen, up to `REMEMBERED` of them.
    """
    needed = pairs.select(F.col("hi").alias("key")).union(pairs.select(F.col("lo").alias("key"))).distinct()
    place = nodes.join(needed, "key", "left_semi").select(
        "key", F.col("doc_id").alias("n_id"), F.col("text_hash").alias("n_hash")
    )
    texts = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_hash"), "text")
    same = F.col("t_id").eqNullSafe(F.col("n_id")) & (F.col("t_hash") == F.col("n_hash"))
    texts = stage(texts.join(place, same).select("key", "text").dropDuplicates(["key"]), "texts")
    both = pairs.join(texts.select(F.col("key").alias("hi"), F.col("text").alias("a")), "hi").join(
        texts.select(F.col("key").alias("lo"), F.col("text").alias("b")), "lo"
    )
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hashes, recent, held = shared.value, WordHashes(), OrderedDict(), 0

        def of(key: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, float]:
            nonlocal held
            if key not in recent:
                v, w = weighted(shingles(words_of(text), hashes, p.words), frequent)
                recent[key] = v, w, float(w.sum())
                held += len(v)
                while held > REMEMBERED and len(recent) > 2:
                    held -= len(recent.popitem(last=False)[1][0])
            return recent[key]

        for batch in batches:
            close = []
            columns = (batch.column("hi").to_pylist(), batch.column("lo").to_pylist(), utf8_values(batch.column("a")), utf8_values(batch.column("b")))
            for hi, lo, a, b in zip(*columns, strict=True):
                (v, w, s), (x, y, z) = of(hi, a), of(lo, b)
                at = np.minimum(np.searchsorted(x, v), len(x) - 1)
                same = x[at] == v
                least = float(np.minimum(w[same], y[at[same]]).sum())
                close.append(least >= p.similarity * (s + z - least) - 1e-9)
            yield batch.select(["hi", "lo"]).filter(pa.array(close, pa.bool_()))

    return map_batches(both.select("hi", "lo", "a", "b"), run, "hi binary, lo binary")


def _edge(a, b) -> list:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """doc_id, text_hash and class_id for every row of `docs`.

    The class is the smallest doc_id among the documents that a chain of links joins;
    two are linked if the weighted Jaccard similarity of their shingles is `similarity`
    or more. Documents with the same words are one node. Texts without words (null,
    empty) are linked to nothing: their class is their own doc_id. Null ids are linked
    like others but name no class unless no member has an id.

    1. Every node is compared with the central node of each of its buckets: that whose
       buckets are the fullest in all, which in a family of copies is close to what they
       were made from. A bucket of any size gives as many pairs as it has members, and
       most of a family is one component after that.
    2. In the buckets that still hold several components, members of different
       components are paired where sketches and samples allow the similarity, and compared.
    Both use grouped counts and maxima, so a bucket is never gathered.
    """
    common = common_shingles(docs, p)
    signed = stage(signatures(docs, common, p), "signatures")
    marks = ["bits", "weight", "lightest", *WORDS]
    nodes = stage(
        signed.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"),
            *[F.first(c).alias(c) for c in ("bands", "bits", "weight", "lightest", "sketch")],
        )
        .select("key", "rep.doc_id", "rep.text_hash", "bands", "bits", "weight", "lightest",
                *[F.col("sketch")[i].alias(w) for i, w in enumerate(WORDS)]),
        "nodes",
    )
    members = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(members.join(sizes, ["band", "bucket"]), "shared")
    central = shared.groupBy("key").agg(F.sum("n").alias("full"))
    buckets = stage(shared.join(central, "key"), "buckets")
    pivots = buckets.groupBy("band", "bucket").agg(F.max(F.struct("full", "key")).alias("o")).select(
        "band", "bucket", F.col("o.key").alias("o_key")
    )
    starred = buckets.join(pivots, ["band", "bucket"]).where("key <> o_key").select("key", "o_key").distinct()
    others = nodes.select(*[F.col(c).alias(f"o_{c}") for c in ("key", *marks)])
    stars = stage(
        starred.join(nodes.select("key", *marks), "key").join(others, "o_key").where(_possible(p))
        .select(*_edge(F.col("key"), F.col("o_key"))).distinct(),
        "pairs",
    )
    links = stage(verify(stars, nodes, docs, common, p), "links")
    roots = connected_components(links)

    held = buckets.select("band", "bucket", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = (
        held.groupBy("band", "bucket").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z")
        .select("band", "bucket")
    )
    marks.append("bands")
    rest = stage(held.join(mixed, ["band", "bucket"]).join(nodes.select("key", *marks), "key"), "rest")
    others = rest.select("band", "bucket", *[F.col(c).alias(f"o_{c}") for c in ("key", "root", *marks)])
    pairs = (
        rest.join(others, ["band", "bucket"])
        .where((F.col("root") < F.col("o_root")) & _possible(p) & _first_bucket())
        .select(*_edge(F.col("key"), F.col("o_key")))
        .join(stars, ["hi", "lo"], "left_anti")
    )
    more = verify(stage(pairs, "pairs"), nodes, docs, common, p)
    roots = stage(connected_components(links.union(more)), "roots")

    # Classes take the smallest id of their nodes.
    own = nodes.select("key", F.col("doc_id").alias("own"))
    classed = own.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classed.groupBy("root").agg(F.min("own").alias("class_id"))
    classes = stage(classed.join(least, "root").select("key", "class_id"), "classes")
    return signed.select("doc_id", "text_hash", "key").join(classes, "key", "left").select(
        "doc_id", "text_hash", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def keep_one(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """`docs` with one document of each class: that with the smallest doc_id.

    Rows without an id stay, and so do rows that repeat the kept id with another text;
    of rows equal in id and text one stays.
    """
    classes = near_duplicates(docs, p).select(
        F.col("doc_id").alias("_n_id"), F.col("text_hash").alias("_n_hash"), "class_id"
    )
    # One number for a missing id, so that the join and the removal of repeats share a shuffle.
    no_id = F.lit(-(1 << 63))
    kept = (
        classes.where(F.col("_n_id").isNull() | (F.col("_n_id") == F.col("class_id")))
        .select(F.coalesce("_n_id", no_id).alias("_n_row"), F.col("_n_hash").alias("_n_text"))
        .distinct()
    )
    rows = docs.withColumn("_n_row", F.coalesce("doc_id", no_id)).withColumn("_n_text", F.xxhash64("text"))
    chosen = rows.join(kept, ["_n_row", "_n_text"], "left_semi")
    return chosen.dropDuplicates(["_n_row", "_n_text"]).select(*docs.columns)
