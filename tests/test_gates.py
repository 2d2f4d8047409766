"""Robots rules, roll-ups over trees, generation plans and counts against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumengrid.operators import generation, hierarchy, robots

RULES = "host string, agent string, allow boolean, prefix string"


def brute_gate(url, rules, agent):
    m = re.search("://([^/?#]*)([^#]*)", url or "")
    if not m:
        return True, None
    host, path = m[1].lower(), m[2] if m[2].startswith("/") else "/" + m[2]
    own = [r for r in rules if r[0] == host and r[3] and r[1].lower() == agent] or [r for r in rules if r[0] == host and r[3] and r[1] == "*"]
    fit = [(len(r[3]), r[2], r[3]) for r in own if path.startswith(r[3])]
    return (max(fit)[1], max(fit)[2]) if fit else (True, None)


def test_the_longest_rule_decides(spark):
    rng = random.Random(5)
    hosts = ["a.org", "b.net", "c.de"]

    def path():
        return "".join(rng.choice(["/x", "/y", "/", "?q=1", "z"]) for _ in range(rng.randint(0, 4)))

    rules = [(rng.choice(hosts), rng.choice(["*", "*", "Bot", "other"]), rng.random() < 0.5, rng.choice(["", "/"]) + path()) for _ in range(60)]
    urls = [(k, rng.choice(["http://", "https://"]) + rng.choice([*hosts, "A.ORG", "none.com"]) + path() + rng.choice(["", "#f"])) for k in range(300)] + [(900, None), (901, "no host"), (902, "http://a.org"), (903, "")]
    got = {r["url_id"]: (r["allowed"], r["rule"]) for r in robots.gated(spark.createDataFrame(urls, "url_id long, url string"), spark.createDataFrame(rules, RULES), "bot").collect()}
    assert got == {k: brute_gate(u, rules, "bot") for k, u in urls}
    assert {a for a, _ in got.values()} == {True, False}


def test_urls_never_meet_all_rules(spark):
    """One host with many rules: rows of the join are those that fit, cut to the rules' lengths."""
    rules = spark.createDataFrame([("h", "*", k % 2 == 0, f"/p{k:05}") for k in range(3000)] + [("h", "*", True, "/p")], RULES)
    urls = spark.range(2000).select(F.col("id").alias("url_id"), F.concat(F.lit("http://h/p"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("/rest")).alias("url"))
    got = robots.gated(urls, rules, "bot")
    assert got.where("allowed").count() == 1000 and got.where("rule = '/p'").count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


NODES = "node long, parent long, value long"


def tree(spark, rows):
    return {r["node"]: (r["depth"], r["n_below"], r["total"]) for r in hierarchy.rolled_up(spark.createDataFrame(rows, NODES)).collect()}


def brute_tree(rows):
    parent = {n: p for n, p, _ in rows}
    below = {n: [0, 0] for n in parent}
    depth = {}
    for n, _, value in rows:
        at, steps = n, 0
        while at in parent and steps <= len(rows):
            below[at][0] += 1
            below[at][1] += value or 0
            at, steps = parent[at], steps + 1
        depth[n] = steps - 1 if steps <= len(rows) else None
    return {n: (depth[n], *below[n]) if depth[n] is not None else (None, None, None) for n in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "dangling", "cycle"])
def test_rollups_equal_walking_up(spark, shape):
    rng = random.Random(3)
    if shape == "random":
        rows = [(k, rng.randrange(k) if k and rng.random() < 0.95 else None, rng.choice([None, 0, 5, -2])) for k in range(150)]
    elif shape == "chain":
        rows = [(k, k - 1 if k else None, k) for k in range(70)]
    elif shape == "star":
        rows = [(0, None, 1)] + [(k, 0, k) for k in range(1, 200)]
    elif shape == "dangling":
        rows = [(1, 99, 1), (2, 1, 2), (3, None, 3)]
    else:
        rows = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 3, 1), (5, 5, 1), (6, None, 1), (7, 6, 1)]
    assert tree(spark, rows) == brute_tree(rows)


def test_rollup_of_nothing(spark):
    assert tree(spark, []) == {}


def test_items_of_plans(spark):
    cases = {
        "tax:vat:hard:2,law:firm:mid": [("tax", "vat", "hard", 2, None), ("law", "firm", "mid", 1, None)],
        " tax : vat : mid : +2 , ": [("tax", "vat", "mid", 2, None)],
        "tax:vat": [("tax", "vat", None, None, "format")],
        "tax:vat:mid:1:x": [("tax", "vat", "mid", None, "format")],
        "art:vat:mid": [("art", "vat", "mid", None, "subject")],
        "tax: :mid": [("tax", "", "mid", None, "unit")],
        "tax:vat:odd": [("tax", "vat", "odd", None, "difficulty")],
        "tax:vat:mid:two,tax:vat:mid:": [("tax", "vat", "mid", None, "count")] * 2,
        "tax:vat:mid:0,tax:vat:mid:-2": [("tax", "vat", "mid", None, "count_below_one")] * 2,
        " , ,": [(None, None, None, None, "empty")],
        "": [(None, None, None, None, "empty")],
        None: [(None, None, None, None, "empty")],
    }
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", generation.items_of(F.col("s"), ["tax", "law"]).alias("i")).collect()
    assert {r["s"]: [tuple(x)[1:] for x in r["i"]] for r in rows} == cases


def test_counts_are_taken_in_the_write(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 3).alias("k"))
    found = generation.written_with_counts(rows, f"{tmp_path}/out", F.col("k") == 1, {"ones": F.col("k") == 1, "nulls": F.col("k").isNull(), "never": F.col("k") > 5})
    assert found == {"ones": spark.read.parquet(f"{tmp_path}/out").count(), "nulls": 10, "never": 0} and found["ones"] == 30
