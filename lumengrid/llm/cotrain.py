"""A quality classifier by co-training: a text-content view and a page-metadata view teach each other.

* The content view sees hashed runs of 1 to 3 bytes of the whole text (as shares) and how many of the words are distinct or
  repeat the word before.
* The metadata view sees what describes a page without its wording: source and language (hashed), size, and layout (lines,
  capitals, symbols, digits, word length).

Both are logistic models trained in numpy on the same bounded sample of labelled rows. In each round, a pool of unlabelled
rows is filled up with ones not seen before, and each view gives the other its most confident pseudo-labels for it, in the
classes' proportions; what the rounds see together is bounded. On labelled rows
that neither saw, each view is calibrated (a logistic map of its score), and a logistic map of both calibrated views gives
the score. Scoring is one pass over the whole texts without a shuffle: the models are folded into tables of 1,024 weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import hash_sample
from lumengrid.llm.wordhash import SEPARATOR, factors, whole_texts, words

BUCKETS = 1024
META = 64 + 16 + 8
LONGEST = 3
#: Calibrated log-odds of a view count up to this, so a view that errs with confidence can be outweighed.
MOST = 5.0
_MIX = (factors(8, 41) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_KIND = np.zeros((4, 256), bool)  # lines, capitals, symbols, digits
_KIND[0, 10] = _KIND[1, 65:91] = _KIND[3, 48:58] = True
_KIND[2, [33, 35, 36, 37, 38, 42, 60, 62, 124]] = True


def runs(data: np.ndarray, offsets: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of each run of 1 to LONGEST bytes inside a text that begins at one of the first ``starts``
    places (anywhere, unless given)."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found, owner, h = [], [], np.zeros(len(data), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + (data[n - 1 :].astype(np.uint32) + np.uint32(1)) * _MIX[n]
        same = doc[: len(doc) - n + 1] == doc[n - 1 :]
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x85EBCA6B)
        found.append(((x ^ (x >> np.uint32(13))) % np.uint32(BUCKETS))[:starts][same[:starts]])
        owner.append(doc[: len(doc) - n + 1][:starts][same[:starts]])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owner)


def parts(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``runs`` some at a time where a very long text comes alone: its parts overlap by LONGEST - 1 bytes, and each run counts
    in the part it begins in."""
    if len(data) <= most or len(offsets) > 2:
        yield runs(data, offsets)
        return
    for a in range(0, len(data), most):
        part = data[a : a + most + LONGEST - 1]
        yield runs(part, np.array([0, len(part)]), most)


def variety(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two numbers for each text: the logarithm of distinct words per word (and 0.02), and the root of the share of words
    that repeat the word before."""
    h, doc = words(data, offsets)
    n = len(offsets) - 1
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return np.stack([np.log(np.bincount(doc[new], minlength=n) / count + 0.02), np.sqrt(again / count)], axis=1)


def metadata(data: np.ndarray, offsets: np.ndarray, source: list, lang: list) -> np.ndarray:
    """The metadata view of each text: a row of META numbers."""
    n = len(offsets) - 1
    out = np.zeros((n, META), np.float32)
    sizes = np.diff(offsets).astype(np.float64)
    out[np.arange(n), [zlib.crc32(f"s:{s}".encode()) % 64 for s in source]] = 1
    out[np.arange(n), [64 + zlib.crc32(f"l:{x}".encode()) % 16 for x in lang]] = 1
    sums = np.zeros((6, n))
    if len(data):
        some = sizes > 0
        at = offsets[:-1][some]
        starts = ~SEPARATOR[data]
        starts[1:] &= SEPARATOR[data[:-1]]
        for k, marks in enumerate([*_KIND[:, data], SEPARATOR[data], starts]):
            sums[k, some] = np.add.reduceat(marks.astype(np.int64), at)
    room = np.maximum(sizes, 1)
    out[:, 80] = np.log1p(sizes) / 10
    out[:, 81] = np.log1p(sums[0]) / 5
    out[:, 82:85] = np.minimum((sums[1:4] / room).T * 20, 1)
    out[:, 85] = sums[4] / room
    out[:, 86] = np.minimum((sizes - sums[4]) / np.maximum(sums[5], 1), 50) / 10
    out[:, 87] = np.minimum(sizes / (sums[0] + 1), 2000) / 1000
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 120, rate: float = 0.1, start: np.ndarray | None = None) -> np.ndarray:
    """Weights with the bias last, by Adam on the whole of (standardized) x."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (_sigmoid(x @ w) - y).astype(x.dtype) / len(y) + ridge * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Views:
    """Raw-feature weights (bias last) of both views, their calibrations (slope, offset) and the final map (two slopes, offset)."""

    content: np.ndarray
    meta: np.ndarray
    content_map: np.ndarray
    meta_map: np.ndarray
    final: np.ndarray


def cotrain(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = 4, share: float = 0.1) -> Views | None:
    """x: both views of labelled rows; pool: of unlabelled rows. None without labelled rows."""
    if not len(y):
        return None
    folds = np.arange(len(y)) % 4
    fit, held = (folds != 0, folds == 0) if len(y) >= 40 else (np.ones(len(y), bool),) * 2
    scales = [(v[fit].mean(axis=0), v[fit].std(axis=0) + floor) for v, floor in zip(x, (1e-4, 0.05), strict=True)]
    z = [((v - m) / s).astype(np.float32) for v, (m, s) in zip(x, scales, strict=True)]
    u = [((v - m) / s).astype(np.float32) for v, (m, s) in zip(pool, scales, strict=True)]
    taught = [np.full(len(u[0]), -1), np.full(len(u[0]), -1)]  # pseudo-labels that each view has been given
    fresh = np.array_split(np.arange(len(u[0])), max(rounds, 1))  # the pool is filled up with rows not seen before
    w: list = [None, None]
    prior = y[fit].mean()
    for r in range(rounds + 1):
        for k in (0, 1):
            extra = taught[k] >= 0
            w[k] = logistic(np.vstack([z[k][fit], u[k][extra]]), np.r_[y[fit], taught[k][extra]], ridge=(3e-3, 1e-2)[k], start=w[k])
        if r == rounds or not len(u[0]):
            break
        there = np.arange(len(u[0])) <= fresh[r].max(initial=-1)
        for k in (0, 1):
            p = _sigmoid(u[k] @ w[k][:-1] + w[k][-1])
            free = np.flatnonzero((taught[1 - k] < 0) & there)
            many = max(1, int(share * there.sum()))
            order = free[np.argsort(p[free], kind="stable")]
            low, high = order[: int(many * (1 - prior)) + 1], order[::-1][: int(many * prior) + 1]
            taught[1 - k][low[p[low] < 0.05]] = 0
            taught[1 - k][high[p[high] > 0.95]] = 1
    maps, scores = [], []
    for k in (0, 1):
        s = (z[k][held] @ w[k][:-1] + w[k][-1])[:, None]
        maps.append(logistic(s, y[held], ridge=1e-2, steps=400))
        scores.append(np.clip(s[:, 0] * maps[-1][0] + maps[-1][1], -MOST, MOST))
    final = logistic(np.stack(scores, axis=1), y[held], ridge=1e-2, steps=400)
    raw = [np.r_[w[k][:-1] / scales[k][1], w[k][-1] - (w[k][:-1] * scales[k][0] / scales[k][1]).sum()] for k in (0, 1)]
    return Views(raw[0], raw[1], maps[0], maps[1], final)


def _sample(docs: DataFrame, ids: list[int]) -> tuple[list[int], list[np.ndarray]]:
    """Both views of the rows with these ids (a bounded list), made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, offsets in whole_texts(b.column(1), 1 << 18):
                n = len(offsets) - 1
                bucket, doc = runs(data, offsets)
                counts = np.bincount(doc.astype(np.int64) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
                content = np.hstack([counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), variety(data, offsets)]).astype(np.float32)
                meta = metadata(data, offsets, b.column(2).slice(i, n).to_pylist(), b.column(3).slice(i, n).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array([r.tobytes() for r in content], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], ["doc_id", "content", "meta"])

    if not ids:
        return [], [np.zeros((0, BUCKETS + 2), np.float32), np.zeros((0, META), np.float32)]
    row = F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    picked = docs.where(F.col("doc_id").isin(ids)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(row).alias("row")).select("doc_id", "row.*")
    rows = sorted(picked.mapInArrow(run, "doc_id long, content binary, meta binary").collect())  # a row for each id
    return [r.doc_id for r in rows], [np.array([np.frombuffer(r.content, np.float32) for r in rows]), np.array([np.frombuffer(r.meta, np.float32) for r in rows])]


def score(docs: DataFrame, model: Views | None) -> DataFrame:
    """doc_id, text_score, meta_score, score for each row; 0.5 each without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.content[:BUCKETS]
        for b in batches:
            for i, data, offsets in whole_texts(b.column(1), 1 << 18):
                n = len(offsets) - 1
                sums, seen = np.zeros(n), np.zeros(n)
                for bucket, doc in parts(data, offsets):
                    sums += np.bincount(doc, table[bucket], n)
                    seen += np.bincount(doc, minlength=n)
                content = sums / np.maximum(seen, 1) + variety(data, offsets) @ model.content[BUCKETS:-1] + model.content[-1]
                meta = metadata(data, offsets, b.column(2).slice(i, n).to_pylist(), b.column(3).slice(i, n).to_pylist()) @ model.meta[:-1] + model.meta[-1]
                views = [np.clip(s * m[0] + m[1], -MOST, MOST) for s, m in ((content, model.content_map), (meta, model.meta_map))]
                both = views[0] * model.final[0] + views[1] * model.final[1] + model.final[2]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), *[pa.array(_sigmoid(v), pa.float64()) for v in (*views, both)]], ["doc_id", "text_score", "meta_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string"), F.col("lang").cast("string"))
    if model is None:
        return rows.select("doc_id", *[F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")])
    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled_rows: int = 3000, pool_rows: int = 4000, keep_from: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept (score >= keep_from): one row for each row of ``docs``.

    ``docs``: doc_id, text, source, lang; ``labels``: doc_id and ``label`` (1: good); other columns are ignored. Training
    takes at most ``labelled_rows`` labelled and ``pool_rows`` other ids, those of the least hashes (of rows that repeat an
    id, the least). A null text counts as empty; null sources and languages are values of their own; an id with two labels counts as its larger one. Without
    labels all scores are 0.5. Repeated rows score alike; an empty table gives no rows.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    y = {r.doc_id: int(r.y) for r in hash_sample(known, ["doc_id"], labelled_rows).collect()}
    others = [r.doc_id for r in hash_sample(docs.where("doc_id is not null").select("doc_id"), ["doc_id"], 2 * pool_rows, 9).collect()]
    taken = {r.doc_id for r in labels.where(F.col("doc_id").isin(others)).select("doc_id").distinct().collect()} if others else set()
    pool = sorted(set(others) - taken)[:pool_rows]
    ids, views = _sample(docs, sorted({*y, *pool}))
    labelled = np.array([i in y for i in ids], bool)
    model = cotrain([v[labelled] for v in views], np.array([y[i] for i in ids if i in y], float), [v[~labelled] for v in views])
    return score(docs, model).withColumn("kept", F.col("score") >= keep_from)
