"""Lloyd's rounds over integer vectors, exact, with ns-bounds.

Each vector keeps, for every centroid, a lower bound on its distance and the round in which that was evaluated, and an upper
bound for its own centroid. All centroids of all rounds are retained, so a bound is loosened by the norm of the centroid's
total displacement since its evaluation (norm of a sum), which is never more than the sum of its drifts round by round.
Where the loosened bounds leave no centroid as near as the own one, nothing is computed; else the own distance is made exact
and the centroids that still can be as near are rescanned. Distances are integers and ties go to the smaller number, so
assignments are those of plain Lloyd rounds.

A round is one pass over a written table of vectors with their bounds; each task also adds up its vectors by centroid, so
centroids move by some rows a task and nothing is shuffled but those. The history has rounds x centroids x dimensions
numbers, all of them parameters, and goes to tasks with the code. Components whose squares a double holds exactly are
computed in doubles, larger ones in Python's integers, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import discard, materialize

STATE = "vec_id long, vector binary, cluster int, bounds binary, limb int, sums array<long>, n long"
LONG_MOST = 2**63 - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x): doubles if each is exact with its square, also summed over a row's differences; else Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(256 * x.astype(np.float64))
    if fits(out):
        return out
    return np.array([[math.floor(256 * v) if math.isfinite(256 * v) else math.floor(v) * 256 for v in row] for row in x.astype(np.float64).tolist()], object).reshape(x.shape)


def fits(v: np.ndarray) -> bool:
    return not v.size or bool(np.abs(v).max() <= math.sqrt(2**53 / v.shape[1]) / 2 - 1)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, exact: of doubles that fit, or of Python integers."""
    return np.concatenate([((v[i : i + 65536] - c[i : i + 65536]) ** 2).sum(axis=1) for i in range(0, len(v), 65536)]) if len(v) else np.zeros(0, v.dtype)


def root(d: np.ndarray) -> np.ndarray:
    """Square roots in double precision; of integers beyond it, infinity."""
    if d.dtype == object:
        d = np.array([float(x) if x < 2**1000 else math.inf for x in d], np.float64)
    return np.sqrt(d)


class Bounds:
    """A block's own centroids and bounds. On a row's bytes: the upper bound, its centroids' lower bounds, their rounds."""

    def __init__(self, k: int):
        self.kind = np.dtype([("up", "<f8"), ("low", "<f4", (k,)), ("at", "<u2", (k,))])

    def fresh(self, n: int) -> np.ndarray:
        state = np.zeros(n, self.kind)
        state["up"], state["low"] = np.inf, -np.inf
        return state

    @staticmethod
    def assign(v: np.ndarray, own: np.ndarray, state: np.ndarray, history: list[np.ndarray], moved: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest of the last centroids for each row, with ``state`` brought up to date, and how many distances that
        took. ``moved[s, j]``: how far centroid j is from where it was in round s."""
        now, centroids, k = len(history) - 1, history[-1], len(history[-1])
        rows = np.arange(len(v))
        low = state["low"].astype(np.float64) - moved[state["at"], np.arange(k)]
        up = state["up"] + moved[state["at"][rows, own], own]
        low[rows, own] = np.inf
        rescan = np.flatnonzero(~(low.min(axis=1) > up))
        if not len(rescan):
            return own, 0

        def evaluated(r: np.ndarray, j: np.ndarray) -> np.ndarray:
            d = squared(v[r], centroids[j])
            near = root(d)
            state["low"][r, j] = np.nextafter(np.minimum(near, 3e38).astype(np.float32), np.float32(-np.inf))
            state["at"][r, j] = now
            return d

        best = own.copy()
        d = evaluated(rescan, own[rescan])
        up = root(d) * (1 + 1e-12)
        r, j = np.nonzero(~(low[rescan] > up[:, None]) & (np.arange(k)[None, :] != own[rescan][:, None]))
        others = evaluated(rescan[r], j)
        # of each row's distances the least, of equal ones the smallest centroid
        all_rows, all_j, all_d = np.concatenate([np.arange(len(rescan)), r]), np.concatenate([own[rescan], j]), np.concatenate([d, others])
        order = sorted(range(len(all_d)), key=lambda i: (all_rows[i], all_d[i], all_j[i])) if all_d.dtype == object else np.lexsort((all_j, all_d, all_rows))
        first = np.asarray(order)[np.searchsorted(all_rows[order], np.arange(len(rescan)))]
        best[rescan] = all_j[first]
        state["up"][rescan] = root(all_d[first]) * (1 + 1e-12)
        return best, len(all_d)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[s, j]: the norm of what centroid j has moved by since round s, rounded up."""
    return np.array([root(squared(h, history[-1])) * (1 + 1e-12) for h in history]).reshape(len(history), -1)


def limbs(total: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Integers as parts of 32 bits (the last signed), so that sums of the parts fit into longs: (place, parts)."""
    place = 0
    while place == 0 or any(total):
        last = all(-(2**31) <= x < 2**31 for x in total)
        yield place, [x if last else x & 0xFFFFFFFF for x in total]
        total = [0] * len(total) if last else [x >> 32 for x in total]
        place += 1


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2:", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<string> of decimal integers): one row a kept vector.

    Kept are vectors of exactly ``dim`` components, none of them null or not finite, as integers floor(256 x). The first
    centroids are the ``k`` kept vectors of the least sha256 of ``seed`` and vec_id (a null one counts as empty text; rows
    that repeat a vec_id ascend by vector); fewer vectors make fewer centroids. Each of ``rounds`` rounds assigns every vector
    (ties to the smaller number) and moves every centroid that has vectors to their mean, rounded down; one more assignment
    follows. Rows that repeat count as often. Distances and sums over the range of a long are given as its largest value,
    and take part in comparisons as they are. Other columns are ignored; an empty table gives no rows.
    """
    if rounds >= 1 << 16:
        raise ValueError("rounds are counted in 16 bits")
    v = F.col(vector)
    double = dict(vectors.dtypes)[vector].startswith("array<double")
    kind = np.dtype("<f8" if double else "<f4")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = vectors.where(v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>" if double else "array<float>").alias("v"))
    first = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "v").limit(k)
    starts = np.array([r["v"] for r in first.collect()], kind).reshape(-1, dim)
    bounds = Bounds(len(starts))

    def common(history: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Block and centroids both in doubles, or both in Python's integers."""
        if block.dtype != object and all(h.dtype != object for h in history):
            return block, history
        whole = [h if h.dtype == object else np.array([[int(x) for x in row] for row in h], object).reshape(h.shape) for h in [block, *history]]
        return whole[0], whole[1:]

    def blocks(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(b.column("vector").to_pylist()), kind).reshape(b.num_rows, dim)
        return raw, integers(raw)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes, not yet evaluated."""
        for b in batches:
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in raw], pa.binary())], ["vec_id", "vector"])

    def one_round(history: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved = displacements(history)
            sums = [[0] * dim for _ in starts]
            n = [0] * len(starts)
            for b in batches:
                if not b.num_rows:
                    continue
                _, ints = blocks(b)
                fresh = "bounds" not in b.schema.names
                state = bounds.fresh(b.num_rows) if fresh else np.frombuffer(b"".join(b.column("bounds").to_pylist()), bounds.kind).copy()
                own = np.zeros(b.num_rows, np.int64) if fresh else b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                block, centroids = common(history, ints)
                own, _ = bounds.assign(block, own, state, centroids, moved)
                for j in np.unique(own).tolist():
                    part = ints[own == j]
                    sums[j] = [s + int(x) for s, x in zip(sums[j], part.sum(axis=0), strict=True)]
                    n[j] += len(part)
                nothing = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.list_(pa.int64()), pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(own.astype(np.int32)), pa.array([s.tobytes() for s in state], pa.binary()), *nothing], [f.split()[0] for f in STATE.split(", ")])
            rows = [(None, None, j, None, place, part, n[j] if not place else 0) for j in range(len(starts)) if n[j] for place, part in limbs(sums[j])]
            if rows:
                types = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in STATE.split(", ")])

        return run

    def last(history: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved = displacements(history)
            for b in batches:
                if not b.num_rows:
                    continue
                block, centroids = common(history, blocks(b)[1])
                fresh = "bounds" not in b.schema.names
                state = bounds.fresh(b.num_rows) if fresh else np.frombuffer(b"".join(b.column("bounds").to_pylist()), bounds.kind).copy()
                own = np.zeros(b.num_rows, np.int64) if fresh else b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                own, _ = bounds.assign(block, own, state, centroids, moved)
                d = [min(int(x), LONG_MOST) for x in squared(block, centroids[-1][own])]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

        return run

    history = [integers(starts)]
    table = materialize(kept.mapInArrow(written, "vec_id long, vector binary"), "vectors")
    for _ in range(rounds if len(starts) else 0):
        rows = table.where("limb IS NULL").select("vec_id", "vector", "cluster", "bounds") if "limb" in table.columns else table
        done = materialize(rows.mapInArrow(one_round(history), STATE), "bounds")
        discard(table)
        table = done
        added = table.where("limb IS NOT NULL").groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)))
        means: list[list[int]] = [[int(x) for x in c] for c in history[-1].tolist()]
        total: dict[int, list] = {}
        for r in added.collect():  # some rows a centroid
            n, sums = total.setdefault(r["cluster"], [0, [0] * dim])
            total[r["cluster"]] = [n + r["n"], [s + (r[f"s{i}"] << 32 * r["limb"]) for i, s in enumerate(sums)]]
        for j, (n, sums) in total.items():
            means[j] = [s // n for s in sums]
        new = np.array(means, object).reshape(-1, dim)
        history.append(new.astype(np.float64) if max(abs(x) for row in means for x in row) < 2**52 and fits(new.astype(np.float64)) else new)
    rows = table.where("limb IS NULL").select("vec_id", "vector", "cluster", "bounds") if "limb" in table.columns else table
    found = materialize(rows.mapInArrow(last(history), "vec_id long, cluster int, distance long"), "clusters")
    discard(table)
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid

    def within(x: int) -> int:
        return min(int(x), LONG_MOST)

    inertia = within(sum(r["s"] for r in by_cluster))
    final = [[str(int(x)) for x in c] for c in history[-1].tolist()]
    facts = [(r["cluster"], within(r["s"]), inertia, final[r["cluster"]]) for r in by_cluster]
    clusters = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
