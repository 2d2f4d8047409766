"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest; SQL functions alone.

The trees are trained from labelled URLs: those that a rule decides, at most ``sample_rows`` of them by hash order. Each
feature is cut at its quantiles, and the sample is written once as counts by bins; a level of a tree is one aggregate of
gradients by node, feature and bin, whose result (nodes x features x bins, a few hundred rows) is all that the driver sees.
Statistics of suffixes are a table of numbers with six rows for each suffix of the sample, so at most ``6 * sample_rows`` rows
of 28 bytes, and are broadcast; a row that is trained on sees those of the other folds alone. A model is a sum of nested CASE expressions, so scoring is one projection over the scan,
without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import discard, hash_sample, let, materialize

# Fixed values of the contract: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Suffix figures of a row that is trained on come from the other folds (of its url's hash), so its own label is not in them.
FOLDS = 5
FEATURES = ["length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "hyphens", "suffix_rate", "suffix_share"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. Rules of one length: the longer host, then by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def lexical(url: Column, host: Column) -> dict[str, Column]:
    """The features of a URL by itself."""
    n = F.length(url)
    digits = n - F.length(F.regexp_replace(url, "[0-9]", ""))

    def entropy(chars: Column) -> Column:
        total = F.greatest(F.size(chars), F.lit(1)).cast("double")

        def add(s: Column, c: Column) -> Column:
            share = (n - F.length(F.replace(url, c, F.lit("")))) / total
            return s - share * F.log2(share)

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), add)

    return {
        "length": n.cast("double"),
        "depth": (n - F.length(F.replace(url, F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": digits / F.greatest(n, F.lit(1)),
        "entropy": F.when(url == "", 0.0).otherwise(let(F.split(url, ""), entropy)),
        "parameters": (n - F.length(F.regexp_replace(url, "[?&]", ""))).cast("double"),
        "host_length": F.length(host).cast("double"),
        "hyphens": (n - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    """The host's last label."""
    return F.element_at(F.split(host, "\\."), -1)


@dataclass
class Trees:
    """Each tree: (feature number, edge number, left, right), whose sides are trees or numbers; a value up to an edge goes
    left. suffixes: (suffix_key, suffix_rate, suffix_share), or None where there were no labels."""

    base: float
    trees: list
    edges: list[list[float]]
    suffixes: DataFrame | None
    prior: float

    def score(self, below=None) -> Column:
        """The log-odds of block, over columns named as FEATURES (or by ``below``: (feature, edge) -> Column)."""
        below = below or (lambda k, e: F.col(FEATURES[k]) <= self.edges[k][e])

        def value(node) -> Column:
            if isinstance(node, tuple):
                return F.when(below(node[0], node[1]), value(node[2])).otherwise(value(node[3]))
            return F.lit(float(node))

        return sum((value(t) for t in self.trees), F.lit(float(self.base)))


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def with_features(rows: DataFrame, model: Trees, training: bool = False) -> DataFrame:
    """rows (url, host, ...) with the columns of FEATURES; in ``training``, a row's suffix figures are those of the other
    folds."""
    out = rows.withColumns(lexical(F.col("url"), F.col("host")))
    if model.suffixes is None:
        return out.withColumns({"suffix_rate": F.lit(model.prior), "suffix_share": F.lit(0.0)})
    fold = _fold(F.col("url")) if training else F.lit(-1)
    found = out.withColumns({"suffix_key": F.xxhash64(suffix_of(F.col("host"))), "suffix_fold": fold}).join(F.broadcast(model.suffixes), ["suffix_key", "suffix_fold"], "left")
    return found.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(model.prior)), "suffix_share": F.coalesce("suffix_share", F.lit(0.0))}).drop("suffix_key", "suffix_fold")


def suffix_table(labelled: DataFrame, n: int, prior: float) -> DataFrame:
    """suffix_key, suffix_fold, suffix_rate (of block, drawn to the prior), suffix_share: for each suffix of ``labelled`` one
    row of all its rows (fold -1), and one for each fold of all but that fold's."""
    key = F.xxhash64(suffix_of(F.col("host"))).alias("suffix_key")
    sums = labelled.groupBy(key, _fold(F.col("url")).alias("f")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    each = sums.groupBy("suffix_key").agg(F.collect_list(F.struct("f", "n", "y")).alias("parts"))  # FOLDS at most

    def figures(fold: Column) -> Column:
        rest = F.filter("parts", lambda p: p["f"] != fold)
        count, blocked = (F.aggregate(rest, F.lit(0).cast("long"), lambda s, p: s + p[c]) for c in ("n", "y"))
        return F.struct(fold.alias("suffix_fold"), ((blocked + 10 * prior) / (count + 10)).alias("suffix_rate"), (count / n).alias("suffix_share"))

    folds = F.transform(F.sequence(F.lit(-1), F.lit(FOLDS - 1)), figures)
    return materialize(each.select("suffix_key", F.inline(folds)), "url-suffixes")


def boost(labelled: DataFrame, rounds: int = 10, bins: int = 16, rate: float = 0.3, suffixes: bool = True) -> Trees:
    """Trees of depth two under logistic loss. labelled: url, host, y (1: block), a bounded sample (its suffixes are sent to
    every task). Without ``suffixes``, the features of suffixes are constant."""
    total = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, y = total["n"] or 0, total["y"] or 0
    prior = (y + 1) / (n + 2)
    model = Trees(math.log(prior / (1 - prior)), [], [], suffix_table(labelled, n, prior) if n and suffixes else None, prior)
    if not n or y in (0, n):
        return model
    rows = materialize(with_features(labelled, model, training=True).groupBy("y", *FEATURES).agg(F.count("*").alias("w")), "url-features")
    cuts = rows.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 1000).alias(f) for f in FEATURES]).first()
    model.edges = [sorted({float(x) for x in cuts[f]}) for f in FEATURES]

    def bin_of(k: int) -> Column:
        """How many edges lie below the value, so a bin up to e is a value up to edge e."""
        return F.size(F.filter(F.array(*[F.lit(e) for e in model.edges[k]]), lambda e: e < F.col(FEATURES[k]))).alias(f"b{k}")

    names = [f"b{k}" for k in range(len(FEATURES))]
    binned = rows.select("y", "w", *[bin_of(k) for k in range(len(FEATURES))]).groupBy("y", *names).agg(F.sum("w").alias("w"))
    binned = materialize(binned, "url-bins")
    discard(rows)
    each = F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("b")) for k, c in enumerate(names)])

    def below(k: int, e: int) -> Column:
        return F.col(names[k]) <= e

    def histogram(chance: Column, node: Column) -> dict:
        g, h = F.col("w") * (F.col("y") - chance), F.col("w") * chance * (1 - chance)
        spread = binned.select(node.alias("node"), g.alias("g"), h.alias("h"), F.explode(each).alias("c"))
        out: dict = {}
        for r in spread.groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
        return out

    def split(found: dict):
        """The best (feature number, edge number) of a node with the two leaves' values; None where no cut helps."""
        best = None
        for k in sorted(found):
            g, h = (sum(v[i] for v in found[k].values()) for i in (0, 1))
            gl = hl = 0.0
            for b in range(len(model.edges[k])):
                a = found[k].get(b, (0.0, 0.0))
                gl, hl = gl + a[0], hl + a[1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, k, b, rate * gl / (hl + 1), rate * (g - gl) / (h - hl + 1))
        return best[1:] if best and best[0] > 1e-6 else None

    for _ in range(rounds):
        chance = 1 / (1 + F.exp(-model.score(below)))
        root = split(histogram(chance, F.lit(0)).get(0, {}))
        if root is None:
            break
        parts = histogram(chance, F.when(below(*root[:2]), 0).otherwise(1))
        sides = [split(parts.get(side, {})) or root[2 + side] for side in (0, 1)]
        model.trees.append((*root[:2], *sides))
    discard(binned)
    return model


def log_loss(rows: DataFrame, model: Trees) -> float:
    """The mean logistic loss of a model over labelled rows (url, host, y) that it was not trained on; null without rows."""
    score = with_features(rows, model).select("y", model.score().alias("s"))
    return score.agg(F.avg(F.log1p(F.exp(-F.abs("s"))) + F.greatest(F.col("s"), F.lit(0.0)) - F.col("y") * F.col("s"))).first()[0]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample_rows: int = 20_000, rounds: int = 10, block_from: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, chance (the model's, of block) for each row of ``pages`` (page_id, url).

    A null url, or one without ://, has an empty host and path, no rule, and the model's verdict; other columns are
    ignored. Without labelled URLs, or with labels of one kind, the chance is their share (smoothed). Repeated rows are
    judged alike; an empty table gives no rows.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    labelled = rows.where("verdict is not null").select("page_id", "url", "host", (F.col("verdict") == "block").cast("int").alias("y"))
    sample = hash_sample(labelled, ["page_id", "url"], sample_rows).select("url", "host", "y")
    model = boost(materialize(sample, "url-sample"), rounds)
    chance = 1 / (1 + F.exp(-model.score()))
    scored = with_features(rows, model).select("page_id", "host", "path", "rule", "verdict", chance.alias("chance"))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("chance") >= block_from, "block").otherwise("allow")))
