"""Nearest neighbours by inner product as a block matrix join, exact.

Vectors are dealt by hash into blocks, and each block becomes one row: int8 codes with a scale for each vector, the
originals, and the norms of what the codes leave out. Candidate blocks meet query blocks in tiles. A tile's product of
codes gives an estimate of each inner product with a bound on its error,

    |q.x - q'.x'| <= |q| |x - x'| + |q - q'| |x'|,

so the k-th largest lower bound cuts off every pair whose upper bound lies below it; a bound that is no finite number (norms
over 1e154) cuts off nothing. What survives is recomputed in double precision from the original vectors, dimension by
dimension, so equal vectors get equal scores wherever they lie. A tile (dimension, query block, candidate block) is one
key: both kinds of block are sent to their tiles by one shuffle, and no tile is worked on twice. It is gone through in
strips of 1,024 queries and 2,048 candidates, and hands on the k nearest of each query; the lists of a query, from as many
tiles as there are candidate blocks, are merged by heaps. No pair of rows is ever a row of a join, and a tile holds two
blocks, whatever the number of equal vectors or ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiles share this many tasks at most; a task goes through its tiles one by one.
MOST_TASKS = 20_000
BLOCK = "dim int, block int, ids binary, vectors binary, double boolean"


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quantized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded vectors, norms of the remainders (both rounded up)."""
    x = x.astype(np.float64)
    scale = np.maximum(np.abs(x).max(axis=1) / 127, 5e-324)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    decoded = codes * scale[:, None]
    with np.errstate(over="ignore"):
        return codes, scale, np.linalg.norm(decoded, axis=1) * (1 + 1e-9), np.linalg.norm(x - decoded, axis=1) * (1 + 1e-9) + 1e-300


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in the order of the dimensions."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    total = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(q.shape[1]):
            total += q[:, j] * x[:, j]
    return total


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes. float32 holds sums of 1,024 products of codes exactly; more dimensions are added in float64."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    out = (a[:, :1024] @ b[:, :1024].T).astype(np.float64)
    for j in range(1024, a.shape[1], 1024):
        out += a[:, j : j + 1024] @ b[:, j : j + 1024].T
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, width: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores): the k nearest of each query among x, ties to the smaller id, the query's own id left out."""
    qc, qs, _, qe = quantized(q)
    with np.errstate(over="ignore"):
        q_norm = np.linalg.norm(q.astype(np.float64), axis=1) * (1 + 1e-9)
    best = [[] for _ in range(len(q))]  # heaps of (score, -id), the worst on top
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(x), width):
        part, ids = x[at : at + width], x_ids[at : at + width]
        xc, xs, xn, xe = quantized(part)
        with np.errstate(over="ignore", invalid="ignore"):
            estimate = products(qc, xc) * qs[:, None] * xs[None, :]
            error = q_norm[:, None] * xe[None, :] + qe[:, None] * xn[None, :]
            error += 1e-12 * (np.abs(estimate) + error) + 1e-290
            lower, upper = estimate - error, estimate + error
        lower[~np.isfinite(lower)] = -np.inf
        own = q_ids[:, None] == ids[None, :]
        lower[own] = -np.inf
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k])
        left = ~(upper < floor[:, None]) & ~own
        rows, columns = np.nonzero(left)
        scores = np.concatenate([exact(q[rows[i : i + 65536]], part[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)]) if len(rows) else np.zeros(0)
        number = ~np.isnan(scores)
        rows, columns, scores = rows[number], columns[number], scores[number]
        order = np.lexsort((ids[columns], -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        first = np.searchsorted(rows, rows)
        near = np.arange(len(rows)) - first < k
        for r, c, s in zip(rows[near].tolist(), columns[near].tolist(), scores[near].tolist(), strict=True):
            item, heap = (s, -int(ids[c])), best[r]
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in best])
    found = [(int(q_ids[r]), -i, s) for r, heap in enumerate(best) for s, i in heap]
    a, b, c = zip(*found, strict=True) if found else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.float64)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a component, none of them null or not finite, and one that is not zero; with ``dim``."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine & F.col("vec_id").isNotNull())


def blocks(dealt: DataFrame, double: bool) -> DataFrame:
    """dealt: dim, block, vec_id, v. One row for each block: (dim, block, ids, vectors)."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def row() -> pa.RecordBatch:
            i, x = np.concatenate(ids), np.concatenate(rows)
            values = [key[0], key[1], i.astype("<i8").tobytes(), x.astype(kind).tobytes(), double]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["dim", "block", "ids", "vectors", "double"])

        for b in batches:
            keys = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                now = (int(keys[0, a]), int(keys[1, a]))
                if now != key:
                    if ids:
                        yield row()
                    key, ids, rows = now, [], []
                ids.append(b.column(2).slice(a, z - a).to_numpy(zero_copy_only=False))
                rows.append(_rows(b.column(3).slice(a, z - a)).astype(kind))
        if ids:
            yield row()

    return dealt.repartition("dim", "block").sortWithinPartitions("dim", "block").mapInArrow(run, BLOCK)


def nearest(vectors: DataFrame, query: Column, k: int = 20, vector: str = "embedding", block_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``query`` picks, its k nearest among all others.

    ``vectors``: vec_id and an array of float or double; other columns are ignored. Vectors that are null, empty, zero or
    hold a null or non-finite component take no part, nor do rows without an id. Every row is a candidate, so rows that
    repeat a vec_id are candidates each, but not for a query of that vec_id; where several rows of one vec_id are queries,
    the least vector asks. Vectors meet only those of their own dimension. Ties go to the smaller vec_id; a product that
    overflows to an infinity counts as one, and one that is no number (infinities of both signs) is no candidate. A query
    with fewer than k candidates gets them all, one with none gets no row, as does an empty table.
    """
    double = dict(vectors.dtypes).get(vector, "").startswith("array<double")
    rows = usable(vectors, vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), F.size(vector).alias("dim"), query.alias("is_query"))
    counted = rows.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).first()
    n_blocks = max(1, math.ceil(counted["n"] / block_rows))
    n_queries = max(1, math.ceil((counted["q"] or 0) / query_rows))
    tiles = min(n_blocks * n_queries, MOST_TASKS)

    def dealt(df: DataFrame, by: Column, count: int) -> DataFrame:
        return df.select("dim", F.pmod(F.xxhash64(by), F.lit(count)).cast("int").alias("block"), "vec_id", "v")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # rows of one id are dealt apart; the number of a row depends on the scan alone, so a task that runs again deals alike
    apart = blocks(dealt(rows, F.monotonically_increasing_id(), n_blocks), double)
    asking = rows.where("is_query").groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    asked = blocks(dealt(asking, F.col("vec_id"), n_queries), double)
    candidates = apart.select("dim", each(n_queries).alias("q"), "block", "ids", "vectors").repartition(tiles, "dim", "q", "block")
    queries = asked.select("dim", F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    queries = queries.withColumn("block", each(n_blocks)).repartition(tiles, "dim", "q", "block")
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, q_ids, q, x_ids, x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                q_all, queries_of = np.frombuffer(q_ids, "<i8"), np.frombuffer(q, kind).reshape(-1, dim)
                for at in range(0, len(q_all), 1024):
                    a, c, s = tile(q_all[at : at + 1024], queries_of[at : at + 1024], np.frombuffer(x_ids, "<i8"), np.frombuffer(x, kind).reshape(-1, dim), k)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def top() -> list[tuple]:
            return [(now, r, -i, s) for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            done: list[tuple] = []
            for q, i, s in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if q != now:
                    done += top()
                    now, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
            if done:
                yield out(done)
        if heap:
            yield out(top())

    met = candidates.join(queries.hint("shuffle_merge"), ["dim", "q", "block"]).select("dim", "q_ids", "q_vectors", "ids", "vectors")
    lists = met.mapInArrow(run, "query_id long, vec_id long, score double")
    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
