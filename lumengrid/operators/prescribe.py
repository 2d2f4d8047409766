"""Decision rules against learner state: matches, risk score, concepts to review, prescription ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.operators.graph import substring_pairs
from lumengrid.sources.folders import cut

WILDCARD = "all"
#: More rules are refused, never left out.
MOST_RULES = 10_000


def matches(stage: Column, subjects: Column, tags: Column, groups: dict[str, list[str]]) -> Column:
    """Whether a rule (stages, rule_subjects, rule_tags) fits: empty lists fit all; a group needs all of its members."""
    any_stage = (F.size("stages") == 0) | F.array_contains("stages", stage)

    def fits(s: Column) -> Column:
        out = (s == WILDCARD) | F.array_contains(subjects, s)
        for name, members in groups.items():
            out = out | ((s == name) & (F.size(F.array_except(F.array(*map(F.lit, members)), subjects)) == 0))
        return out

    any_subject = (F.size("rule_subjects") == 0) | F.exists("rule_subjects", fits)
    any_tag = (F.size("rule_tags") == 0) | F.arrays_overlap("rule_tags", tags)
    return any_stage & any_subject & any_tag


def matched_rules(users: DataFrame, rules: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """user_id, rule_key, confidence, position. users: user_id, stage, subjects, tags. rules: written by hand, so few; their
    number is checked, and each is tested against each user where the user is read."""
    fits = matches(F.col("stage"), F.col("subjects"), F.col("tags"), groups)
    count = rules.count()
    if count > MOST_RULES:
        raise ValueError(f"{count} rules; every user is tested against every rule, so there may be {MOST_RULES} at most")
    rows = users.join(F.broadcast(rules), fits)
    order = W.partitionBy("user_id").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "rule_key")
    return rows.select("user_id", "rule_key", "confidence").withColumn("position", F.row_number().over(order))


def risk_score(states: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, score (at most 100), level. states: user_id, accuracy, overrun, mean_mastery (null: no concept).
    users: user_id, days, n_rules."""
    points = (
        F.when(F.col("accuracy") < 0.40, 20).otherwise(0)
        + F.when(F.col("overrun") > 0.30, 15).otherwise(0)
        + F.when(F.col("mean_mastery") < 0.50, 15).otherwise(0)
    )
    sums = states.groupBy("user_id").agg(F.sum(points).alias("points"))
    deadline = F.when(F.col("days") < 30, 25).when(F.col("days") < 60, 10).otherwise(0)
    many = F.when(F.col("n_rules") >= 5, 20).when(F.col("n_rules") >= 3, 10).otherwise(0)
    score = F.least(F.lit(100), F.coalesce("points", F.lit(0)) + deadline + many).cast("long")
    level = F.when(F.col("score") >= 50, "high").when(F.col("score") >= 25, "moderate").otherwise("low")
    return users.join(sums, "user_id", "left").select("user_id", score.alias("score")).withColumn("level", level)


def concepts_to_review(mastery: DataFrame, frequency: DataFrame, keep: int = 3, concepts: DataFrame | None = None) -> DataFrame:
    """user_id, concept, subject, importance, position. frequency: tag, f. A tag counts for a concept that holds it or is
    held by it; distinct concepts are matched first, so the comparison does not grow with the users. concepts: concept, all
    that ``mastery`` has or more; where it is given, mastery is worked out once, and what is known of a concept is written,
    so that it is broadcast while it is small and mastery stays where its users lie."""
    alone = concepts is None
    concepts = mastery.select("concept").distinct() if alone else concepts.where("concept is not null").distinct()
    a, b = concepts.select(F.col("concept").alias("x")), frequency.select(F.col("tag").alias("x")).distinct()
    held = substring_pairs(b.select(F.col("x").alias("needle")), a.select(F.col("x").alias("text_id"), F.col("x").alias("text"))).select(F.col("text_id").alias("concept"), F.col("needle").alias("tag"))
    holding = substring_pairs(a.select(F.col("x").alias("needle")), b.select(F.col("x").alias("text_id"), F.col("x").alias("text"))).select(F.col("needle").alias("concept"), F.col("text_id").alias("tag"))
    pairs = held.union(holding).distinct().join(frequency, "tag").groupBy("concept").agg(F.max("f").alias("f"))
    known = concepts.join(pairs, "concept", "left").select("concept", F.coalesce("f", F.lit(0)).alias("f"))
    known = known if alone else cut(known, "known")
    top = frequency.agg(F.coalesce(F.max("f"), F.lit(0)).alias("top")).first()["top"]
    weakness = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mastery")))
    importance = F.round(0.6 * weakness + (0.4 * F.col("f") / top if top else 0.0), 4)
    rows = mastery.join(known, "concept").select("user_id", "concept", "subject", importance.alias("importance"))
    best = W.partitionBy("user_id", "concept").orderBy(F.desc("importance"), "subject")
    rows = rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    order = W.partitionBy("user_id").orderBy(F.desc("importance"), "concept", "subject")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= keep)


def minutes(count: Column) -> Column:
    """Estimated minutes of a task by the number of signals behind its rule."""
    return F.when(count >= 10, 60).when(count >= 3, 45).otherwise(30)


def task_subject(rule_subjects: Column, subjects: Column) -> Column:
    """The only subject that a rule and a learner share, else ``mixed``."""
    both = F.array_intersect(rule_subjects, subjects)
    return F.when(F.size(both) == 1, F.element_at(both, 1)).otherwise("mixed")


def prescription_id(user: Column, parts: Column) -> Column:
    return F.concat(F.lit("rx-"), user.cast("string"), F.lit("-"), F.left(F.sha2(parts, 256), F.lit(16)))
