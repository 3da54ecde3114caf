"""Operator 13: nearest neighbours by cross-polytope hashing.

Vectors are made unit vectors of one more dimension that keep the order of inner products (the added
component is what a vector lacks of the longest one's length, 0 for queries). Three rounds of random
signs and a fast Hadamard transform rotate them; a hash is the nearest signed axis among the first
axes of the rotated vector. A table joins several such hashes, so that a bucket holds about
``bucket_rows`` rows whatever the table's size. A query looks into several buckets of each table, the
likeliest first, and every candidate there is ranked by its exact inner product.

How many buckets, is fitted: the exact neighbours of ``TUNING`` queries, found in one pass over all
rows, say how far down each list of buckets a query must go. That sample is the only one; every row
is indexed and every query is answered. If the buckets of a fine code don't suffice, a coarser one
is taken; with one axis list they all can be visited, so the recall aimed at is always met on the sample.

A bucket is one unit of work. Rows equal in all components are kept up to k + 1 times (with the
smallest ids), which loses no result, so copies can't swell a bucket. A bucket beyond ``UNIT_ROWS`` is
cut into slices on either side, each pair of slices is a unit, and a unit passes on k rows a query.

Vectors that are null, empty or zero or hold a null or non-finite component, and rows without an id,
take no part. Repeated rows count once; rows of the query's own id are none of its neighbours. Vectors
of unlike length are filled up with zeros. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .common import map_batches

TABLES = 6
BUCKET_ROWS = 512
UNIT_ROWS = 8192
TUNING, RECALL = 256, 0.95
# Bits of one hash, and buckets that a query can list when a table joins several hashes.
HASH_BITS, LISTED = 7, 4096
SEED = 13
_FOUND = "query_id long, vec_id long, score double"


# ------------------------------------------------------------------ hashing
def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


@dataclass(frozen=True)
class CrossPolytope:
    """``tables`` hash functions of ``bits`` bits for vectors of ``size`` components, the longest ``reach`` long."""

    size: int
    reach: float
    bits: int
    tables: int = TABLES

    @property
    def width(self) -> int:
        return 1 << self.size.bit_length()

    @property
    def axes(self) -> list[int]:
        """Axes that each hash of a table tells apart; each gives two values."""
        count = -(-self.bits // min(HASH_BITS, self.width.bit_length()))
        return [1 << (self.bits // count + (i < self.bits % count) - 1) for i in range(count)]

    def rotated(self, x: np.ndarray, table: int, query: bool) -> list[np.ndarray]:
        unit = np.zeros((len(x), self.width))
        unit[:, : x.shape[1]] = x / self.reach
        if query:
            unit /= np.abs(unit).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        else:
            unit[:, self.size] = np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(axis=1)))
        out = []
        for i, axes in enumerate(self.axes):
            signs = np.random.default_rng([SEED, table, i]).choice([-1.0, 1.0], (3, self.width))
            y = unit
            for s in signs:
                y = hadamard(y * s)
            out.append(y[:, :axes])
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row, the nearest signed axes as one number."""
        out = np.zeros((len(x), self.tables), np.int64)
        for table in range(self.tables):
            for y in self.rotated(x, table, False):
                axis = np.abs(y).argmax(axis=1)
                sign = y[np.arange(len(y)), axis] < 0
                out[:, table] = out[:, table] * (2 * y.shape[1]) + 2 * axis + sign
        return out

    def probes(self, x: np.ndarray, count: int) -> list[np.ndarray]:
        """Per table (queries, count or fewer): buckets in falling order of the sum of signed components."""
        out = []
        for table in range(self.tables):
            signed = [np.stack([y, -y], axis=2).reshape(len(y), -1) for y in self.rotated(x, table, True)]
            order = [np.argsort(-s, axis=1, kind="stable") for s in signed]
            if len(signed) == 1:
                out.append(order[0][:, :count].astype(np.int64))
            else:
                out.append(np.array([self._joined([s[i] for s in signed], [o[i] for o in order], count) for i in range(len(x))], np.int64))
        return out

    def _joined(self, signed: list[np.ndarray], order: list[np.ndarray], count: int) -> list[int]:
        """The best combinations of the hashes' values, best first."""
        lists = [s[o] for s, o in zip(signed, order, strict=True)]
        start = (0,) * len(lists)
        heap, seen, out = [(-sum(s[0] for s in lists), start)], {start}, []
        while heap and len(out) < count:
            cost, at = heapq.heappop(heap)
            number = 0
            for o, p in zip(order, at, strict=True):
                number = number * len(o) + int(o[p])
            out.append(number)
            for i, p in enumerate(at):
                after = (*at[:i], p + 1, *at[i + 1 :])
                if p + 1 < len(lists[i]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (cost + lists[i][p] - lists[i][p + 1], after))
        return out


# ------------------------------------------------------------------ exact ranking
def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(column), size))
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in order of the components, so that equal rows score alike wherever they lie."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(position of the query, id, score) of the k nearest rows of each query, ties to smaller ids."""
    rough = queries @ rows.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        # Rounding differs with the order of summation: keep a little more and rank those exactly.
        least = np.partition(rough, -k, axis=1)[:, -k]
        slack = 1e-12 * (np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max())
        keep = (rough >= (least - slack)[:, None]) & (rough > -np.inf)
    else:
        keep = rough > -np.inf
    q, r = np.nonzero(keep)
    score = inner_products(queries[q], rows[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.searchsorted(q, q, side="left")
    top = np.arange(len(q)) - first < k
    return q[top], ids[r[top]], score[top]


def _batch(query_ids, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"]
    )


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score), each pair once."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def exact_nearest(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Brute force for few queries: one pass over (vec_id, vector)."""
    size = queries.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                q, ids, scores = best_of(query_ids, queries, part.column(0).to_numpy(), _matrix(part.column(1), size), k)
                yield _batch(query_ids[q], ids, scores)

    return _nearest(map_batches(rows.select("vec_id", "vector"), search, _FOUND), k)


# ------------------------------------------------------------------ fitting
def _fit(rows: DataFrame, queries: DataFrame, n: int, size: int, reach: float, k: int, tables: int, bucket_rows: int) -> tuple[CrossPolytope, int]:
    """The code and how many buckets a query visits per table, for ``RECALL`` on ``TUNING`` queries."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNING).collect()
    ids = np.array([r.vec_id for r in sample], np.int64)
    vectors = np.zeros((len(sample), size))
    for i, r in enumerate(sample):
        vectors[i, : len(r.vector)] = r.vector
    near = exact_nearest(rows, ids, vectors, k)
    near = near.join(rows, "vec_id").select("query_id", "vec_id", "vector").dropDuplicates(["query_id", "vec_id"]).collect()
    bits = max(1, int(np.log2(max(2.0, n / bucket_rows))))
    if not near:
        return CrossPolytope(size, reach, 1, tables), 2
    who = np.searchsorted(np.sort(ids), [r.query_id for r in near])
    who = np.argsort(ids, kind="stable")[who]
    others = np.zeros((len(near), size))
    for i, r in enumerate(near):
        others[i, : len(r.vector)] = r.vector
    while True:
        code = CrossPolytope(size, reach, bits, tables)
        depth = np.full(len(near), np.inf)
        for own, listed in zip(code.buckets(others).T, code.probes(vectors, LISTED), strict=True):
            hit = listed[who] == own[:, None]
            depth = np.minimum(depth, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, np.inf))
        needed = np.sort(depth)[min(len(depth) - 1, int(np.ceil(RECALL * len(depth))))]
        if np.isfinite(needed):
            return code, int(needed)
        bits -= 1


# ------------------------------------------------------------------ search
def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    held = df.schema[vector_col].dataType.simpleString()
    # Single precision is kept as it is, half the bytes of the doubles it stands for.
    vector = F.col(vector_col).cast(held if held == "array<float>" else "array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # A null component makes forall null or false: either way the row goes.
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _slices(keys: DataFrame, name: str) -> DataFrame:
    """(table, bucket, slices) of buckets with more rows than a unit takes."""
    return (
        keys.groupBy("table", "bucket").count().where(F.col("count") > UNIT_ROWS)
        .select("table", "bucket", F.ceil(F.col("count") / UNIT_ROWS).cast("int").alias(name))
    )


def nearest(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product found for each query.

    ``is_query`` is a condition on the column vec_id.
    """
    rows = stage(_vectors(df, id_col, vector_col), "vectors")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    base = stage(
        rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1)
        .dropDuplicates(["vector", "vec_id"]).select("vec_id", "vector"), "distinct-vectors",
    )
    asked = rows.where(is_query).dropDuplicates(["vec_id", "vector"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, reach = 0, 0, 0.0
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            n, size = n + len(lengths), max(size, int(lengths.max(initial=0)))
            x = _matrix(batch.column(0), int(lengths.max(initial=0)))
            largest = np.abs(x).max(axis=1, initial=0.0)
            reach = max(reach, float((largest * np.linalg.norm(x / largest[:, None], axis=1)).max(initial=0.0)))
        yield pa.RecordBatch.from_pydict({"n": [n], "size": [size], "reach": [reach]})

    found = map_batches(base.select("vector"), measure, "n long, size long, reach double")
    n, size, reach = found.agg(F.sum("n"), F.max("size"), F.max("reach")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    code, visits = _fit(base, asked, n, size, reach, k, tables, bucket_rows)

    kind = base.schema["vector"].dataType.simpleString()

    def hashed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), size)
                if query:
                    per_table = code.probes(x, visits)
                    lists = [[p[i].tolist() for p in per_table] for i in range(len(x))]
                else:
                    lists = code.buckets(x)[:, :, None].tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.list_(pa.int64())))], ["vec_id", "vector", "buckets"])

        return run

    def spread(source: DataFrame, query: bool) -> DataFrame:
        """One row per bucket: (table, bucket, query, vec_id, vector)."""
        held = stage(map_batches(source, hashed(query), f"vec_id long, vector {kind}, buckets array<array<long>>"), "hashed")
        return (
            held.select("vec_id", "vector", F.posexplode("buckets").alias("table", "listed"))
            .select("table", F.explode("listed").alias("bucket"), F.lit(query).alias("query"), "vec_id", "vector")
        )

    index, probes = spread(base, False), spread(asked, True)
    many_rows, many_asked = _slices(index, "row_slices"), _slices(probes, "query_slices")

    def sliced(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.coalesce(own, F.lit(1))).cast("int").alias(own)
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other)
        held = side.join(many_rows, ["table", "bucket"], "left").join(many_asked, ["table", "bucket"], "left")
        held = held.select("table", "bucket", "query", "vec_id", "vector", mine, other)
        return held.select("table", "bucket", "query", "vec_id", "vector", own, theirs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, vectors, rows_of_unit = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            all_ids, x = batch.column(5).to_numpy(), _matrix(batch.column(6), size)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if tuple(keys[lo, :4]) != unit:
                    unit, ids, vectors, rows_of_unit = tuple(keys[lo, :4]), [], [], None
                if not keys[lo, 4]:
                    ids.append(all_ids[lo:hi])
                    vectors.append(x[lo:hi])
                elif ids:
                    if rows_of_unit is None:
                        rows_of_unit = np.concatenate(ids), np.concatenate(vectors)
                    for at in range(lo, hi, 512):
                        mine = slice(at, min(hi, at + 512))
                        q, found, scores = best_of(all_ids[mine], x[mine], *rows_of_unit, k)
                        yield _batch(all_ids[mine][q], found, scores)

    units = ["table", "bucket", "row_slices", "query_slices"]
    met = (
        sliced(index, "row_slices", "query_slices").unionByName(sliced(probes, "query_slices", "row_slices"))
        .repartition(*units).sortWithinPartitions(*units, "query").select(*units, "query", "vec_id", "vector")
    )
    return _nearest(map_batches(met, search, _FOUND), k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of ``exact`` that ``found`` has as well."""
    hits, total = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count("*")).first()
    return hits / total if total else 1.0
