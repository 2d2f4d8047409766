"""What to practise and what to skip: scores, top lists for each user, round robin for newcomers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.sources.folders import cut


def score(accuracy: Column, weak: Column, attempted: Column, pressed: Column) -> Column:
    """A question's score: weakness of its subject, a bonus for a failing subject and for a weak concept, less for a
    question already tried, a little more for a short one under time pressure. A missing accuracy is neutral."""
    base = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(accuracy, F.lit(0.5))))
    return F.round(
        base
        + F.when(accuracy < 0.40, 1.5).otherwise(0.0)
        + F.when(weak, 0.8).otherwise(0.0)
        - F.when(attempted, 0.5).otherwise(0.0)
        + F.when(pressed, 0.2).otherwise(0.0),
        4,
    )


def top(rows: DataFrame, by: list[str], order: list, keep: int, name: str = "position") -> DataFrame:
    """The first ``keep`` rows of each group; Spark drops the rest before the shuffle."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= keep)


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return top(rows, key, order, 1, "_first").drop("_first")


def _first_rank(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy("problem_id")))


def candidates(states: DataFrame, questions: DataFrame, weak: DataFrame, tried: DataFrame, keep: int, pressed_upto: int = 90) -> DataFrame:
    """user_id, problem_id, subject, accuracy, score: questions that hold the ``keep`` best of each user, without a join of
    users to all questions of a subject.

    states: user_id, subject, accuracy, risk (tags). questions: problem_id, subject, concept, limit_seconds. weak: user_id,
    subject, concept (distinct). tried: user_id, problem_id (distinct). A score depends on the question only by its subject,
    whether it is short, its concept's weakness and whether it was tried, and ties go to the smaller id. So the questions of
    a user are classes with a score and a number of questions each, and a class counts only while those with higher scores
    hold fewer than ``keep`` questions. Of these classes the first questions are fetched by rank: ``keep``, and as many more
    as the user has tried or has in a weak concept. All weak concepts of a subject go before its other questions, so where
    the others count, fewer than ``keep`` untried questions are in weak concepts: what is fetched grows with a user's own
    attempts, never with the questions. Subjects in which a user has no state are neutral (accuracy 0.5); their number is
    checked.
    """
    short = F.coalesce(F.col("limit_seconds") <= pressed_upto, F.lit(False))
    q = questions.select("problem_id", "subject", "concept", short.alias("short"))
    profile = cut(states.select("user_id", "subject", "accuracy", F.array_contains("risk", "time_pressure").alias("hurried")), "states")
    keys = ["user_id", "subject", "concept"]

    # a user's concepts, weak or tried: ids of the tried questions, short ones and others
    def ids(of: Column) -> Column:
        return F.collect_list(F.when(of, F.col("problem_id")))

    hit = tried.join(q, "problem_id").groupBy(*keys).agg(ids(F.col("short")).alias("tried_short"), ids(~F.col("short")).alias("tried_long"))
    none = F.array().cast(f"array<{dict(q.dtypes)['problem_id']}>")
    sizes = q.groupBy("subject", "concept").agg(F.count_if("short").alias("size_short"), F.count_if(~F.col("short")).alias("size_long"))
    cells = hit.join(weak.withColumn("weak", F.lit(True)), keys, "full").join(sizes, ["subject", "concept"], "left")
    kept = {c: F.coalesce(c, none) for c in ("tried_short", "tried_long")} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("size_short", "size_long")}
    cells = cut(cells.withColumns(kept | {"weak": F.coalesce("weak", F.lit(False))}), "cells")

    def one(short: bool, weak: Column, attempted: bool, n: Column, passed: Column, size: Column, own: Column) -> Column:
        points = score(F.col("accuracy"), weak, F.lit(attempted), F.col("hurried") & F.lit(short))
        return F.struct(F.lit(short).alias("short"), weak.alias("weak"), F.lit(attempted).alias("attempted"), points.alias("score"), n.cast("long").alias("n"), passed.cast("long").alias("k"), size.alias("size"), own.alias("own"))

    # a concept's classes: its tried questions and, where it is weak, the others
    of_cell = []
    for is_short, name in ((True, "short"), (False, "long")):
        own, size = F.col(f"tried_{name}"), F.col(f"size_{name}")
        of_cell.append(one(is_short, F.col("weak"), True, F.size(own), F.size(own), size, own))
        of_cell.append(one(is_short, F.col("weak"), False, F.when(F.col("weak"), size - F.size(own)).otherwise(0), F.size(own), size, own))
    no_concepts = F.array().cast(f"array<{dict(q.dtypes)['concept']}>")
    in_cells = cells.join(profile, ["user_id", "subject"]).select(*keys, "accuracy", F.inline(F.array(*of_cell))).withColumn("weak_concepts", no_concepts)
    # a subject's classes: its questions outside weak concepts
    passed = cells.groupBy("user_id", "subject").agg(
        F.collect_list(F.when(F.col("weak"), F.col("concept"))).alias("weak_concepts"),
        *(F.sum(F.when(F.col("weak"), F.col(f"size_{n}")).otherwise(F.size(f"tried_{n}"))).alias(f"passed_{n}") for n in ("short", "long")),
        *(F.flatten(F.collect_list(F.when(~F.col("weak"), F.col(f"tried_{n}")))).alias(f"tried_{n}") for n in ("short", "long")),
    )
    all_sizes = q.groupBy("subject").agg(F.count_if("short").alias("size_short"), F.count_if(~F.col("short")).alias("size_long"))
    rest = profile.join(all_sizes, "subject").join(passed, ["user_id", "subject"], "left").withColumn("weak_concepts", F.coalesce("weak_concepts", no_concepts))
    of_rest = []
    for is_short, name in ((True, "short"), (False, "long")):
        gone = F.coalesce(F.col(f"passed_{name}"), F.lit(0))
        of_rest.append(one(is_short, F.lit(False), False, F.col(f"size_{name}") - gone, gone, F.col(f"size_{name}"), F.coalesce(f"tried_{name}", none)))
    in_rest = rest.select("user_id", "subject", F.lit(None).cast("string").alias("concept"), "accuracy", F.inline(F.array(*of_rest)), "weak_concepts")

    # scores have four places, so they are compared as integers
    classes = in_cells.unionByName(in_rest).where("n > 0").withColumn("down", -F.round(10_000 * F.col("score")).cast("long"))
    before = W.partitionBy("user_id").orderBy("down").rangeBetween(W.unboundedPreceding, -1)
    counting = cut(classes.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("above") < keep).drop("above", "down"), "classes")

    columns = ["user_id", "problem_id", "subject", "accuracy", "score"]
    again = counting.where("attempted").withColumn("problem_id", F.explode("own"))
    # no more ranks than the class has questions, and of the questions those with a rank that some user needs
    most = counting.agg(F.max(F.when(~F.col("attempted"), F.least(F.col("k") + keep, "size")))).first()[0] or 0
    fresh = counting.where("NOT attempted").withColumn("rn", F.explode(F.sequence(F.lit(1), F.least(F.col("k") + keep, "size").cast("int"))))
    in_concept = _first_rank(q, ["subject", "concept", "short"]).where(F.col("rn") <= most)
    of_weak = fresh.where("weak").join(in_concept, ["subject", "concept", "short", "rn"])
    in_subject = _first_rank(q, ["subject", "short"]).where(F.col("rn") <= most).withColumnRenamed("concept", "its")
    others = fresh.where("NOT weak").join(in_subject, ["subject", "short", "rn"]).where(~F.coalesce(F.array_contains("weak_concepts", F.col("its")), F.lit(False)))
    untried = of_weak.select(*columns, "own").unionByName(others.select(*columns, "own")).where(~F.array_contains("own", F.col("problem_id")))
    known = again.select(columns).unionByName(untried.select(columns))

    # subjects without a state: one score for all their questions, so a user's first by id are enough. They are among the first
    # of each subject, a short list that goes along as a constant.
    first = top(q, ["subject"], ["problem_id"], keep).select("problem_id", "subject").limit(MOST_SUBJECTS * keep + 1).collect()
    if len({r["subject"] for r in first}) > MOST_SUBJECTS:
        raise ValueError(f"over {MOST_SUBJECTS} subjects")
    kind = f"array<struct<problem_id:{dict(q.dtypes)['problem_id']},subject:string>>"
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in sorted(first)])), kind)
    own = profile.groupBy("user_id").agg(F.collect_set("subject").alias("own"))
    lacking = own.select("user_id", F.inline(F.slice(F.filter(listed, lambda x: ~F.array_contains("own", x["subject"])), 1, keep)))
    neutral = lacking.select("user_id", "problem_id", "subject", F.lit(None).cast("double").alias("accuracy"))
    return known.unionByName(neutral.withColumn("score", score(F.col("accuracy"), F.lit(False), F.lit(False), F.lit(False))))


def in_turn(rows: DataFrame, group: str, order: list, keep: int) -> DataFrame:
    """Like ``round_robin``, with the groups in the order in which they are first seen."""
    ranked = top(rows, [group], order, keep, "turn")
    first = rows.groupBy(group).agg(F.min(F.struct(*order)).alias("_seen"))
    last = ranked.join(first, group).orderBy("turn", "_seen").limit(keep)
    return last.withColumn("position", F.row_number().over(W.orderBy("turn", "_seen"))).drop("_seen")


#: Subjects are a short list; more are refused, never left out.
MOST_SUBJECTS = 1000


def round_robin(rows: DataFrame, group: str, order: list, keep: int) -> DataFrame:
    """Rows taken from the groups in turn. Only the first ``keep`` of each group can be among them."""
    ranked = top(rows, [group], order, keep, "turn")
    last = ranked.orderBy("turn", group).limit(keep)
    return last.withColumn("position", F.row_number().over(W.orderBy("turn", group)))
