"""The near-duplicate stage links from similarity 0.8 on; op4 keeps its 0.85."""

import itertools

from test_search_and_dedup import shingles

from lumengrid.llm import dedup, pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def pair(first, n, both):
    """Two texts of n shingles each, of which they share ``both``."""
    a = [f"a{first}w{k}" for k in range(n + 4)]
    b = a[: both + 4] + [f"b{first}w{k}" for k in range(n - both)]
    return [(first, " ".join(a)), (first + 1, " ".join(b))]


def brute_kept(rows, percent):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root[a], root[b]))
            root = {i: lo if r == hi else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_stage_links_from_eighty_percent(spark):
    # 8/10, 80/100 and 160/200 are exactly 0.8; 166/200 is 0.83; 158/200 is 0.79; 170/200 is 0.85
    sizes = [(9, 8), (90, 80), (180, 160), (183, 166), (179, 158), (185, 170)]
    rows = [r for k, (n, both) in enumerate(sizes * 5) for r in pair(10 * k, n, both)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in pipeline.keep_one_of_each_group(spark, df, "").collect()}
    assert kept == brute_kept(rows, 80) and kept != brute_kept(rows, 85)
    assert {r.doc_id for r in dedup.near_duplicates(df).where("kept").collect()} == brute_kept(rows, 85)


def test_stage_keeps_a_text_whose_id_repeats_with_a_copy(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    df = spark.createDataFrame([(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (7, None, "en", "s", 1), (None, a, "en", "s", 1)], SCHEMA)
    kept = sorted((r.doc_id or 0, r.text or "") for r in pipeline.keep_one_of_each_group(spark, df, "").collect())
    assert kept == sorted([(3, a), (5, b), (7, ""), (0, a)])
