"""Mixing sources to target weights: hierarchical budgets over domain, language and source, filled from seeded epochs.

A token budget goes down a tree of three levels. Under each node it is dealt to the children in proportion to their
weights, none getting more than its leaves hold in ``epochs`` passes; what a child cannot take goes to its siblings in
proportion to their weights, and only what a whole subtree cannot take reaches the siblings one level up. In closed form,
child i gets min(capacity_i, weight_i * level), and windows over the children, ordered by capacity / weight, find the level.

A leaf draws whole epochs and then the longest prefix of one more epoch that fits, in the order of
md5(seed:epoch:doc_id). The cut is found by two steps: token sums by the first hex digits of the hash, then a running sum
inside the one bucket that holds the cut. So no task holds a leaf, though one leaf may be a third of all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.llm.common import materialize

LEVELS = ["domain", "language", "origin"]
#: Leaves that are sent to every task: 8,192 rows of about 200 bytes at most. More leaves are joined by salted keys.
FEW_LEAVES = 8192


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \t\n\x0b\f\r]+"))).cast("long")


def dealt(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children: the parent's columns, ``name``, weight (over 0), capacity, budget (the parent's); ``budget`` becomes the child's."""
    order = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    by_ratio = order.orderBy(F.col("capacity") / F.col("weight"), name)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / (F.sum("weight").over(order) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = children.withColumn("level", level).withColumn("level", F.max("level").over(order))
    return out.withColumn("budget", F.least(F.col("capacity"), F.col("weight") * F.col("level"))).drop("level")


def leaf_budgets(leaves: DataFrame, budget: float, weights: dict[str, Column], epochs: int) -> DataFrame:
    """leaves: LEVELS, tokens. Adds budget (long): the leaf's share. Weights are read from each level's own columns; a
    weight that is null or not over 0 counts as 1e-9, so it is served last."""

    def weight(level: str) -> Column:
        w = weights.get(level, F.lit(1.0)).cast("double")
        return F.when(w > 0, w).otherwise(F.lit(1e-9))

    nodes, parents = None, []
    for name in LEVELS:
        keys = [*parents, name]
        own = leaves.groupBy(*keys).agg((F.sum("tokens") * F.lit(float(epochs))).alias("capacity")).withColumn("weight", weight(name))
        own = own.join(nodes, parents) if nodes is not None else own.withColumn("budget", F.lit(float(budget)))
        nodes, parents = dealt(own, parents, name).select(*keys, "budget"), keys
    return leaves.join(nodes, LEVELS).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


#: Columns of our own inside ``mix``; they carry this mark, and columns of ``docs`` whose names begin with it are set aside.
MARK = "__mix_"


def _spread(leaves: DataFrame, rows: DataFrame, keys: list[str], row: Column, count: int, salts: int = 32) -> DataFrame:
    """rows joined to their leaf: every task gets the leaves if they are few; else by salted keys, so no leaf is hot."""
    if count <= FEW_LEAVES:
        return rows.join(F.broadcast(leaves), keys)
    salt = f"{MARK}salt"
    salted = leaves.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).join(salted, [*keys, salt]).drop(salt)


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, domain: Column, tokens: Column, weights: dict[str, Column], budget_share: float = 0.8, epochs: int = 2, seed: int = 17, bucket_rows: int = 4096) -> DataFrame:
    """``docs`` with domain, language, origin, tokens, copies (columns of these names are replaced): how often each is drawn.

    ``docs``: doc_id, lang, source and what ``domain`` and ``tokens`` read, which may be columns named like the result's;
    other columns are carried along whatever their names. The budget is ``budget_share`` of all tokens. Null domains,
    languages and sources make nodes of their own (named by the empty string). Rows that repeat a doc_id in a leaf share one
    place, so they are drawn or left together. Documents without tokens cost nothing and are drawn with their place. An
    empty table gives no rows.
    """
    result = [*LEVELS, "tokens", "copies"]
    carried = [c for c in docs.columns if c not in result]
    keys = {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}
    named = [F.coalesce(c.cast("string"), F.lit("")) for c in keys.values()]
    base = materialize(docs.select("doc_id", *[c.alias(k) for k, c in zip(keys, named, strict=True)], tokens.cast("long").alias("tokens")), "mixing-base")
    leaves = materialize(base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "mixing-leaves")
    total = leaves.agg(F.count("*").alias("leaves"), F.sum("tokens").alias("tokens"), F.max("n").alias("largest")).first()
    digits = max(1, math.ceil(math.log(max(1, (total["largest"] or 1) / bucket_rows), 16)))
    budgets = leaf_budgets(leaves, budget_share * (total["tokens"] or 0), weights, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(epochs)).cast("long")
    plan = budgets.select(*LEVELS, whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest"))
    plan = materialize(plan, "mixing-plan")
    by_doc = F.col("doc_id")
    placed = _spread(plan, base, LEVELS, by_doc, total["leaves"]).withColumn("place", place(seed, F.col("whole"), by_doc)).withColumn("bucket", F.substring("place", 1, digits))
    sums = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("bucket"))
    cut = sums.withColumn("upto", running).where("upto > rest")
    cut = cut.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("c")).select(*LEVELS, "c.bucket", "c.before")
    cut = materialize(cut, "mixing-cut")
    at_cut = _spread(cut.withColumnRenamed("bucket", "at"), placed, LEVELS, by_doc, total["leaves"]).where("bucket = at")
    inside = F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("place", "doc_id"))
    first_out = at_cut.withColumn("upto", F.col("before") + inside).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("place", "doc_id")).alias("stop"))
    stops = plan.join(first_out, LEVELS, "left").select(*LEVELS, "whole", F.col("stop.place").alias("stop_place"), F.col("stop.doc_id").alias("stop_id"), (F.col("rest") > 0).alias("partial"))
    stops = materialize(stops.select(*[F.col(c).alias(MARK + c) for c in stops.columns]), "mixing-stops")
    leaf = [MARK + c for c in LEVELS]
    # a column of docs whose name has our mark gets one more character until its turn in the result
    aside = {c: f"{MARK}_{c}" for c in carried if c.lower().startswith(MARK)}
    rows = docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in carried], *[c.alias(k) for c, k in zip(named, leaf, strict=True)], tokens.cast("long").alias(f"{MARK}tokens"))
    stop_place, stop_id = F.col(f"{MARK}stop_place"), F.col(f"{MARK}stop_id")
    spot = place(seed, F.col(f"{MARK}whole"), by_doc)
    before_stop = stop_place.isNull() | (spot < stop_place) | ((spot == stop_place) & F.coalesce(by_doc < stop_id, F.lit(False)))
    copies = F.col(f"{MARK}whole") + (F.col(f"{MARK}partial") & before_stop).cast("long")
    out = _spread(stops, rows, leaf, by_doc, total["leaves"])
    return out.select(
        *[F.col(f"`{aside.get(c, c)}`").alias(c) for c in carried], *[F.col(MARK + c).alias(c) for c in LEVELS], F.col(f"{MARK}tokens").alias("tokens"), copies.alias("copies")
    )


# Production parameters of the query and of the pipeline: domains by a source's number, weights by domain and language.
DOMAIN_SQL = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) % 4)"
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def level_weight(column: str, weights: dict[str, float], other: float = 0.05) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out


def mix_documents(docs: DataFrame) -> DataFrame:
    """``mix`` with the production parameters; tokens are words."""
    weights = {"domain": level_weight("domain", DOMAIN_WEIGHTS), "language": level_weight("language", LANGUAGE_WEIGHTS)}
    return mix(docs, F.expr(DOMAIN_SQL), word_count(F.col("text")), weights)
