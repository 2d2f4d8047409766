"""Retrieval that prunes, the automaton, passes and HTML against brute force."""

import random
import re
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import graph, html, retrieve
from lumengrid.operators.passes import passes

WORDS = ["an", "rate", "tax", "lease", "Lease", "of", "net", "가치", "12", "cost basis", "x"]


def said(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def tokens(text):
    return {t.lower() for t in re.findall("[가-힣A-Za-z0-9]{2,}", text or "")}


def points(q, c, boosted):
    query_id, text, _, unit = q
    chunk_id, _, c_unit, keywords, tags, body = c
    own, s = tokens(text), 0.0
    for k in keywords:
        s += 2.0 if k in text or k.lower() in text else 1.0 if tokens(k) & own else 0.0
    s += sum(0.8 for t in tags if tokens(t) & own)
    s += 1.5 * min(1.0, len(tokens(body) & own) / len(own))
    if unit is not None and c_unit is not None:
        s += 1.0 if unit == c_unit else 0.5 if unit in c_unit or c_unit in unit else 0.0
    s = int(s * 1e4 + 0.5) / 1e4
    return int((s + 0.5) * 1e4 + 0.5) / 1e4 if (query_id, chunk_id) in boosted else s


def cases(seed):
    rng = random.Random(seed)
    queries = [(k, said(rng, rng.randint(1, 6)), rng.choice([None, "a", "b"]), rng.choice([None, "u1", "u", "v2"])) for k in range(25)] + [(90, "x", None, "u"), (91, "", "a", None), (92, None, "a", None)]
    chunks = [(k, rng.choice(["a", "b", "general", None]), rng.choice(["u1", "u", "v2", None]), rng.choices(WORDS, k=rng.randint(0, 3)), [said(rng, 2)] * rng.randint(0, 1), said(rng, rng.randint(0, 8))) for k in range(120)]
    boosted = {(rng.randrange(25), rng.randrange(120)) for _ in range(60)}
    return queries, chunks, boosted


@pytest.mark.parametrize("most", [None, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_the_best_chunks_are_those_of_all_pairs(spark, monkeypatch, seed, most):
    queries, chunks, boosted = cases(seed)
    if most:
        monkeypatch.setattr(retrieve, "passes", partial(passes, most_rows=most))
        monkeypatch.setattr(retrieve, "CELLS", 100)
        monkeypatch.setattr(retrieve, "MOST_MARKS", 3)
    q = spark.createDataFrame(queries, "query_id long, text string, subject string, unit string")
    c = spark.createDataFrame(chunks, "chunk_id long, subject string, unit string, keywords array<string>, tags array<string>, text string").repartition(3)
    for b in (set(), boosted):
        extra = spark.createDataFrame(sorted(b), "query_id long, chunk_id long") if b else None
        got = sorted((r["query_id"], r["position"], r["chunk_id"], r["score"]) for r in retrieve.retrieve(q, c, extra).collect())
        want = []
        for one in queries:
            if tokens(one[1]):
                near = sorted((-points(one, x, b), x[0]) for x in chunks if one[2] is None or x[1] in ("general", one[2]))
                want += [(one[0], n, x, -s) for n, (s, x) in enumerate(near[:3], 1) if -s >= 0.5]
        assert got == sorted(want)


def test_few_bodies_are_read_once_the_threshold_stands(monkeypatch):
    """A tag that all share and common words make every chunk a candidate of a plain posting list; the threshold does not."""
    rng = random.Random(3)
    queries = [(k, "common of rate " + " ".join(rng.choices(WORDS, k=3)), None, "u") for k in range(50)]
    chunks = [(k, "general", "u" if k % 100 == 0 else "w", ["Lease"] if k % 50 == 0 else ["qq"], ["common"], "common of " + said(rng, 4), []) for k in range(2000)]
    asked, read = retrieve.Postings(queries), []
    whole = asked.shared
    monkeypatch.setattr(asked, "shared", lambda text: read.append(text) or whole(text))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*chunks, strict=True)], ["chunk_id", "subject", "unit", "keywords", "tags", "text", "lifts"])
    assert len(list(retrieve.best_chunks(asked, iter([batch]), 0.5, 3))) == 150
    assert len(read) < len(chunks) / 10


def test_needles_are_found_in_texts(spark, monkeypatch):
    rng = random.Random(6)
    needles = {"".join(rng.choices("ab가.", k=rng.randint(1, 4))) for _ in range(40)} | {"", None, "abab"}
    texts = [(k, "".join(rng.choices("ab가.\n", k=rng.randint(0, 30)))) for k in range(60)] + [(99, None)]
    n, t = spark.createDataFrame([(x,) for x in needles] * 2, "needle string"), spark.createDataFrame(texts, "text_id long, text string").repartition(3)
    want = {(k, x) for k, text in texts if text for x in needles if x and x in text}
    for most in (200_000, 5):
        monkeypatch.setattr(graph, "passes", lambda rows, most_rows, most=most: passes(rows, most_rows=most))
        got = [(r["text_id"], r["needle"]) for r in graph.substring_pairs(n, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert graph.substring_pairs(n.limit(0), t).count() == 0 == graph.substring_pairs(n, t.limit(0)).count()


def test_bounded_needles_are_those_that_a_text_holds(spark):
    from lumengrid.functions.text import holds

    rng = random.Random(8)
    needles = ["VAT", "b", "12", "가치", "a b", "x.y", "é"]
    texts = [(k, "".join(rng.choices(["VAT", "b", "12", "가치", " ", "a b", "x.y", "é", "-", "E"], k=rng.randint(0, 6)))) for k in range(200)]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "text_id long, text string")
    want = {(r["text_id"], r["needle"]) for r in t.join(n, holds(F.col("text"), F.col("needle"))).collect()}
    assert {(r["text_id"], r["needle"]) for r in graph.substring_pairs(n, t, bounded=True).collect()} == want


def test_containment_explodes_no_text(spark):
    n, t = spark.createDataFrame([("ab",)], "needle string"), spark.range(5).select(F.col("id").alias("text_id"), F.lit("cab").alias("text"))
    plan = graph.substring_pairs(n, t)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan


def test_passes_hold_all_rows_within_bounds(spark):
    rows = spark.range(1000).select("id", F.repeat(F.lit("é"), 50).alias("t"))
    for bounds in ({}, {"most_rows": 90}, {"most_bytes": 20_000}):
        found = list(passes(rows, **bounds))
        assert sorted(r["id"] for p in found for r in p) == list(range(1000))
        assert all(len(p) <= bounds.get("most_rows", 1000) and 104 * len(p) <= bounds.get("most_bytes", 1e9) for p in found)
    assert list(passes(rows.limit(0))) == []


BITS = ["<p>", "</p>", "<br>", "<BR/>", "<svg>", "</svg>", "<svg/>", "<style>", "</style>", "<script>x</p>", "</script>", "<noscript>", "</noscript>", "<title>", "</title>", "a", "b  c", " \t ", "&amp;lt;", "&lt;", "<li>", "</li>", "<div class='a>b'>", "</div>", "<!-- c <p> -->", "<section>", "<h4>", "<tr/>", '<p a="</p>">', "<!DOCTYPE x>", "</ z>", "1 < 2 >"]


def brute_page(bits):
    """Every piece is judged by what stands before it, over again."""
    raw, out, kept = None, [], []
    for b in bits:  # what a script or style holds is no markup
        if raw and not b.startswith(f"</{raw}"):
            b = b[b.index(f"</{raw}") :] if f"</{raw}" in b else None
        if b is None:
            continue
        raw = None
        kept.append(b)
        raw = {"<script>x</p>": "script", "<style>": "style"}.get(b)
    for k, b in enumerate(kept):
        open_, titled = [], False
        for x in kept[:k]:
            m = re.match("<(/?)([a-z][a-z0-9]*)[^/]*(/?)>?", x.lower()) if not x.startswith(("<!", "</ ")) else None
            if m and x not in ("1 < 2 >",):
                name = m[2]
                if name in html.SKIPPED and not x.endswith("/>"):
                    if m[1]:
                        open_ = open_[:-1] if open_[-1:] == [name] else open_
                    else:
                        open_.append(name)
                titled = (not m[1]) if name == "title" else titled
        tag = re.match("<(/?)([a-zA-Z][a-z0-9A-Z]*)", b)
        if tag and not b.startswith("<!"):
            name = tag[2].lower()
            if (name in html.LINE_BEGINS and not tag[1]) or (name in html.LINE_ENDS and (tag[1] or b.endswith("/>"))):
                out.append("\n")
        elif not b.startswith(("<!", "</ ")) and not open_:
            out.append((b, titled))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_html_against_judging_every_piece_anew(seed):
    from html import unescape

    rng = random.Random(seed)
    for _ in range(400):
        bits = rng.choices(BITS, k=rng.randint(1, 14))
        out = brute_page(bits)
        words = [w if isinstance(w, str) else w[0] for w in out]
        flat = re.sub("\\s+", "", unescape(unescape("".join(words))))
        title, text = html.page_text("".join(bits))
        assert re.sub("\\s+", "", text) == flat, bits
        assert re.sub("\\s+", "", title) == re.sub("\\s+", "", unescape("".join(w[0] for w in out if not isinstance(w, str) and w[1]))), bits
        lines = [re.sub("\\s+", "", unescape(unescape(x))) for x in "".join(words).split("\n")]
        assert [re.sub("\\s+", "", x) for x in text.split("\n") if x.strip()] == [x for x in lines if x], bits


def test_html_of_broken_tags():
    assert html.page_text("a <b") == ("", "a < b") and html.page_text("<p>x<p") == ("", "x < p")
    assert html.page_text("<script>x") == ("", "") and html.page_text("<!-- x") == ("", "")
    assert html.page_text("<" * 200_000)[1].count("<") == 200_000
    assert html.page_text("<a " * 50_000)[0] == ""
