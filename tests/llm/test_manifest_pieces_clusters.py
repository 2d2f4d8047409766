"""Merkle manifest, SentencePiece ids and clusters against brute force, with nulls, ties, repeats, odd texts, empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumengrid.llm import kmeans, manifest, pieces, queries
from lumengrid.llm.queries import piece_path

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Manifest


def leaf_of(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree_of(nodes, fan):
    """(root, siblings of each leaf: a list of (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fan * fan : i // fan * fan + fan]
            paths[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return (nodes or [None])[0], paths


def manifest_of(rows, fan):
    """All (doc_id, leaf, path, subroot, root) by plain loops."""
    parts = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found, tops = [], []
    for part in parts:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_of(r)) for r in rows if r[1] == part))
        top, paths = tree_of([x[2] for x in own], fan)
        tops.append(top)
        found.append([(x[1] if x[0] else None, x[2], p, top) for x, p in zip(own, paths, strict=True)])
    root, over = tree_of(tops, fan)
    return [(d, leaf, p + q, top, root) for own, q in zip(found, over, strict=True) for d, leaf, p, top in own]


def manifest_rows(spark, rows, fan, depth):
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit(1) for c in ("part", "digest", "item", "rank", "block", "path", "root", "leaf", "task", "spread", "by")})
    got = manifest.manifest(df, "source", "doc_id", [F.col(c) for c in FIELDS], [F.col("doc_id")], fan, depth)
    return [(r["doc_id"], r["leaf"], [(s["left"], s["right"]) for s in r["path"]], r["subroot"], r["root"]) for r in got.collect()]


@pytest.mark.parametrize(("fan", "depth"), [(3, 1), (3, 2), (2, 3), (3, 6)])
def test_manifest_is_that_of_plain_loops(spark, fan, depth):
    rng = random.Random(fan * 10 + depth)
    rows = [(rng.choice([None, k, 7]), rng.choice(["a", "a", "a", "é", "Z", "", None]), rng.choice(["en", None]), rng.choice([0, None]), rng.choice(["", "x\ny", None, "ü" * 50])) for k in range(150)]
    rows += [rows[0]] * 20 + [(k, f"s{k}", None, None, None) for k in range(30)]

    def key(r):
        return str(r)

    assert sorted(manifest_rows(spark, rows, fan, depth), key=key) == sorted(manifest_of(rows, fan), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, "s", "en", k, "t") for k in range(n)]
    assert sorted(manifest_rows(spark, rows, 3, 1)) == sorted(manifest_of(rows, 3))


def test_manifest_of_an_empty_table(spark):
    assert manifest_rows(spark, [], 3, 2) == []


def test_tampered_texts_lead_elsewhere(spark, tmp_path):
    rows = [(k, "ab"[k % 2], "en", k, text) for k in range(12) for text in [["one\ntwo", "plain", None, ""][k % 4]]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    import zlib

    for d, leaf, path, top, root in manifest_of(rows, 3):
        x = leaf
        if zlib.crc32(str(d).encode()) % 2 == 0:
            row = rows[d]
            x = leaf_of((*row[:4], row[4].replace("\n", "") if row[4] is not None else None))
        for left, right in path:
            x = sha(left, x, right)
        r = got[d]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, top, root)
        assert r["proof_sha256"] == sha(*(s for p in path for s in p)) and r["folded_root"] == x and r["verified"] == (x == root)
    assert {r["verified"] for r in got.values()} == {True, False}


def test_no_join_makes_a_proof(spark):
    rows = spark.createDataFrame([(k, "s", "en", k, "t") for k in range(30)], DOCS)
    got = manifest.manifest(rows, "source", "doc_id", [F.col(c) for c in FIELDS], [F.col("doc_id")], 3, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Window" not in plan


# Pieces

ODD = [None, "", " ", "   ", "a", " a", "a ", "  a  b ", "▁", "▁▁a ▁b", "a\nb\n\n c", "\t x\r\n", "\x00 y", "日本語のテキスト 漢字", "x" * 3000, "é é ﬁ ① 　wide", "🙂🙂 z", "<0x0A> <s> </s> <unk>", "the the the", "ab " * 2000, "   x", "{\r\n}\r", "word​word"]


def encoded(spark, texts, **limits):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, block int, ids string").repartition(3)
    got = pieces.decode(pieces.encode(df, piece_path(), **limits), piece_path())
    return {r["doc_id"]: (list(r["ids"]), r["text"]) for r in got.collect()}


@pytest.mark.parametrize("limits", [{}, {"block_chunks": 3}, {"block_positions": 5}])
def test_pieces_are_the_librarys(spark, limits):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    words = "the cat sat ▁ on  mats, über\nall 漢字 12,5 \t".split(" ")
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    got = encoded(spark, texts, **limits)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[k] == (ids, library.decode(ids)), t


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tab,"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_make_up_the_text(text):
    seg = pieces.segmenter(piece_path())
    assert seg.by_words
    assert [i for c in seg.ids(seg.chunks(text)) for i in c] == seg.model.encode(text)


def test_a_model_that_crosses_markers_takes_whole_texts(spark, monkeypatch):
    seg = pieces.segmenter(piece_path())
    monkeypatch.setattr(seg, "by_words", False)
    text = "  the cat ▁ sat "
    assert seg.chunks(text) == [text] and seg.ids([text]) == [seg.model.encode(text)]


def test_pieces_of_null_keys_repeats_and_empty_tables(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), piece_path()).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in got) == [("1", 2), ("1", 2), ("2", 0), ("None", 2)]
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), piece_path()).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_numbers_come_back(numbers):
    assert pieces.unpacked(pieces.packed(np.array(numbers, np.uint32))).tolist() == numbers


def test_op12_on_a_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = library.encode(d["text"] or "")
        want[d["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


# Clusters

DIM = 3


def lloyd(rows, k, rounds):
    """(vec_id, cluster, distance) and centroids by plain loops over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            part = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if part:
                c[j] = [sum(x) // len(part) for x in zip(*part, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def check(spark, rows, k, rounds, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3).withColumns({c: F.lit(1) for c in ("vector", "cluster", "bounds", "limb", "distance", "v")})
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as the type holds them
    got = kmeans.cluster(df, k, rounds, DIM).collect()
    want, c = lloyd(rows, k, rounds)
    most = kmeans.LONG_MOST

    def key(r):
        return str(r)

    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(((i, j, min(d, most)) for i, j, d in want), key=key)
    for r in got:
        assert r["cluster_inertia"] == min(most, sum(min(d, most) for _, j, d in want if j == r["cluster"]))
        assert r["inertia"] == min(most, sum(min(d, most) for _, _, d in want)) and r["centroid"] == [str(x) for x in c[r["cluster"]]]


def test_clusters_are_those_of_plain_rounds(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(3 * (k % 5), 1) for _ in range(DIM)]) for k in range(300)]
    check(spark, rows, 8, 6)


def test_clusters_with_ties_repeats_and_what_takes_no_part(spark):
    rng = random.Random(9)
    rows = [(k, [float(rng.randint(-1, 1)) for _ in range(DIM)]) for k in range(80)] + [(5, [1.0, 0.0, 0.0])] * 40
    rows += [(None, [0.5, 0.5, 0.5]), (900, None), (901, []), (902, [1.0, None, 2.0]), (903, [math.nan, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0]), (905, [0.0] * DIM), (906, [1.0] * (DIM + 1))]
    check(spark, rows, 7, 4)


def test_clusters_of_large_numbers(spark):
    """Squares beyond doubles, sums beyond longs."""
    rng = random.Random(2)
    check(spark, [(k, [rng.gauss(0, 1) * 10.0 ** rng.randint(-2, 12) for _ in range(DIM)]) for k in range(60)], 5, 3, "double")
    check(spark, [(k, [rng.gauss(0, 1) * 10.0 ** rng.randint(0, 37) for _ in range(DIM)]) for k in range(40)], 4, 3)


def test_clusters_of_few_rows_or_none(spark):
    check(spark, [(1, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 2.0])], 5, 3)
    check(spark, [], 5, 3)


def test_total_displacement_saves_more_than_summed_drifts():
    """Centroids that go back and forth: bounds by total displacement stay tight, those by summed drifts do not."""
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 40, (2000, 8)) + 600 * (np.arange(2000) % 6)[:, None])
    base = v[:6].copy()
    history, bounds = [base], kmeans.Bounds(6)
    state, own = bounds.fresh(len(v)), np.zeros(len(v), np.int64)
    own, work = kmeans.Bounds.assign(v, own, state, history, kmeans.displacements(history))
    assert work == len(v) * 6
    drifts, done = np.zeros(6), []
    for t in range(1, 9):
        history.append(base + (150 if t % 2 else 0))
        drifts = drifts + np.linalg.norm(history[-1] - history[-2], axis=1)
        own, work = kmeans.Bounds.assign(v, own, state, history, kmeans.displacements(history))
        brute = ((v[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (own == brute.argmin(axis=1)).all()
        done.append(work)
    assert drifts.min() > 600 * math.sqrt(8) and max(done[1::2]) == 0 and sum(done) < len(v) * 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**90), 2**90), min_size=1, max_size=4))
def test_limbs_add_up(total):
    found = list(kmeans.limbs(total))
    assert [sum(p[i] << 32 * place for place, p in found) for i in range(len(total))] == total
    assert all(-(2**31) <= x < 2**32 for _, p in found for x in p)
