"""Nearest neighbours and near-duplicates against brute force."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import ann, dedup, wordhash


def brute_nearest(rows, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = []
    for q in sorted(i for i in fine if i % 20 == 0):
        near = []
        for i, v in fine.items():
            if i != q and len(v) == len(fine[q]):
                s = 0.0
                for a, b in zip(fine[q].tolist(), v.tolist(), strict=True):
                    s += a * b
                near.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


def nearest(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("rank", F.lit("clash")).withColumn("block", F.lit(1))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **more).collect())


@pytest.mark.parametrize(("kind", "dim"), [("float", 8), ("double", 5)])
def test_nearest_equals_brute_force(spark, kind, dim):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, dim)).astype(np.float32)
    x[100:180] = x[100]  # many equal vectors: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert nearest(spark, rows, kind, k=7, block_rows=64, query_rows=6) == brute_nearest(rows, 7)


def test_nearest_leaves_out_what_has_no_direction(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, []), (60, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, [2.0, 1.0]), (5, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (80, [3.0, 3.0])]
    assert nearest(spark, rows, k=20) == [(0, 1, 80, 3.0), (0, 2, 4, 2.0), (80, 1, 4, 9.0), (80, 2, 0, 3.0)]


def test_nearest_of_repeated_rows_and_of_nothing(spark):
    rows = [(0, [1.0]), (0, [0.5]), (1, [2.0]), (1, [2.0]), (1, [3.0])]  # every row is a candidate; the least vector asks
    assert nearest(spark, rows, k=5) == [(0, 1, 1, 1.5), (0, 2, 1, 1.0), (0, 3, 1, 1.0)]
    assert nearest(spark, [], k=5) == [] and nearest(spark, [(1, [1.0])], k=5) == []


def test_nearest_of_huge_and_tiny_doubles(spark):
    """Norms and bounds overflow from 1e154 on, and squares vanish under 1e-162; no candidate may go with them."""
    rows = [(0, [1e160, 1e100]), (20, [1e-170, 1e-170]), (40, [2.0, -1.0]), (1, [1e160, 1.0]), (2, [-1e160, 2.0]), (3, [1e-170, 3e-170]), (4, [1.0, 1.0])]
    rows += [(i, [float(i), 1e150]) for i in range(100, 140) if i % 20]
    assert nearest(spark, rows, "double", k=6, block_rows=8) == brute_nearest(rows, 6)
    rows = [(0, [1e200, -1e200]), (1, [1e200, 1e200]), (2, [1e200, -1e200]), (3, [1.0, 0.0])]
    assert nearest(spark, rows, "double", k=6) == [(0, 1, 2, float("inf")), (0, 2, 3, 1e200)]


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(50, 1500)) * 10.0 ** rng.integers(-3, 4, (50, 1)), rng.normal(size=(60, 1500))
    qc, qs, _, qe = ann.quantized(q)
    xc, xs, xn, xe = ann.quantized(x)
    estimate = ann.products(qc, xc) * qs[:, None] * xs[None, :]
    bound = np.linalg.norm(q, axis=1)[:, None] * xe[None, :] + qe[:, None] * xn[None, :]
    assert (np.abs(q @ x.T - estimate) <= bound * (1 + 1e-6)).all()
    assert (ann.products(qc, xc) == qc.astype(int) @ xc.astype(int).T).all()


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def components(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("kept", F.lit("clash"))
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df, **more).collect())


def edited(rng, words, n):
    words = list(words)
    for i in rng.integers(0, len(words), n):
        words[i] = f"new{rng.integers(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(1000 + i, " ".join(f"w{k}" for k in rng.integers(0, 300, rng.integers(1, 120)))) for i in range(60)]
    base = [f"b{k}" for k in range(400)]
    rows += [(2000 + i, edited(rng, base, int(rng.integers(0, 14)))) for i in range(60)]  # many near and not so near copies
    rows += [(3000 + i, rows[5][1].upper()) for i in range(20)]
    rows += [(1, "one two three four"), (2, "ONE  two\nthree\tfour"), (3, "one"), (4, ""), (5, None), (6, " \n\t"), (7, "x " * 30_000), (8, "X " * 29_999)]
    want = brute_components(rows)
    assert components(spark, rows) == want
    assert components(spark, rows, block_shingles=20_000) == want  # groups dealt out in pairs of blocks


def test_near_duplicates_of_nothing_and_of_odd_ids(spark):
    assert components(spark, []) == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect())
    assert got == {(None, None, True): 1, (3, 3, True): 2, (9, 3, False): 1}


def test_ids_that_repeat_with_other_texts_lose_no_link(spark):
    a, b = " ".join(f"a{k}" for k in range(90)), " ".join(f"b{k}" for k in range(90))
    rows = [(5, a), (5, b), (9, a + " x"), (10, b + " y"), (11, a + " z"), (5, b), (5, b)]
    assert components(spark, rows) == sorted([(5, 86, 5, True)] * 4 + [(9, 87, 5, False), (10, 87, 5, False), (11, 87, 5, False)])


@pytest.mark.parametrize(("block_shingles", "most_copies"), [(10_000, 0), (10_000, 1000), (25_000, 16), (250_000, 16)])
def test_chains_of_a_common_passage_equal_brute_force(spark, monkeypatch, block_shingles, most_copies):
    """Many texts share a passage and hang together by weak links only; some of them are copies with few edits."""
    monkeypatch.setattr(dedup, "MOST_COPIES", most_copies)  # 0: by band key, 1000: by group
    rng = np.random.default_rng(6)
    passage = [f"p{k}" for k in range(100)]
    rows = [(i, " ".join(passage + [f"t{i}w{k}" for k in range(int(rng.integers(5, 60)))])) for i in range(150)]
    rows += [(200 + i, edited(rng, rows[int(rng.integers(0, 150))][1].split(" "), int(rng.integers(0, 4)))) for i in range(150)]
    assert components(spark, rows, block_shingles=block_shingles) == brute_components(rows)


def test_sketches_fill_and_concentrate():
    rng = np.random.default_rng(4)
    seeds = wordhash.factors(640, 5)
    for n in (1, 3, 40, 2000):
        a = wordhash.mix(rng.integers(0, 2**63, n).astype(np.uint64))
        s = dedup.fast_sketch(a, 320, seeds)
        assert (s != np.uint64(2**64 - 1)).all()
        assert (dedup.fast_sketch(a[::-1].copy(), 320, seeds) == s).all()
    a = wordhash.mix(np.arange(1000, dtype=np.uint64))
    b = np.concatenate([a[:900], wordhash.mix(np.arange(5000, 5100, dtype=np.uint64))])
    same = (dedup.fast_sketch(a, 320, seeds) == dedup.fast_sketch(b, 320, seeds)).mean()
    assert abs(same - 900 / 1100) < 0.08


def test_overlaps_are_exact():
    rng = np.random.default_rng(5)
    for m, top in ((40, 60), (90, 200), (30, 5000)):
        sets = [np.unique(rng.integers(0, top, 50)).astype(np.uint64) for _ in range(m)]
        both = dedup.overlaps(sets, dense_from=8)
        assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(m) if i != j)
