"""From attempts to learner state: accuracy, overrun, risk tags, mastery, stage.

attempts: user_id, problem_id, correct, seconds, mistakes. problems: problem_id, subject, limit_seconds, tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The thresholds of the inferred tags and the stage ladder.
OVERRUN_TAG_FROM = 0.30
GAP_TAG_BELOW = 0.40
STAGES = [(30, 0.0, "post_lecture"), (80, 0.50, "objective_entry"), (200, 0.62, "past_exam_rotation"), (400, 0.72, "mock_exam")]


def subject_state(attempts: DataFrame, problems: DataFrame) -> DataFrame:
    """user_id, subject, n, n_correct, n_timed, n_over, accuracy, overrun: one aggregate over one join."""
    return subject_state_of(attempts.join(problems.select("problem_id", "subject", "limit_seconds"), "problem_id"))


def subject_state_of(rows: DataFrame) -> DataFrame:
    """The same from attempts with their problems: user_id, subject, correct, seconds, limit_seconds."""
    over = F.col("seconds") > F.col("limit_seconds")
    out = rows.groupBy("user_id", "subject").agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.count("limit_seconds").alias("n_timed"),
        F.count_if(over).alias("n_over"),
    )
    return _rated(out)


def _rated(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "accuracy": F.round(F.col("n_correct") / F.col("n"), 4),
            "overrun": F.round(F.coalesce(F.try_divide("n_over", "n_timed"), F.lit(0.0)), 4),
        }
    )


def concept_mastery(attempts: DataFrame, problems: DataFrame, concept: Column) -> DataFrame:
    """user_id, subject, concept, n, n_correct, mastery: by the problem's main concept; problems without one do not count."""
    return concept_mastery_of(attempts.join(problems.select("problem_id", "subject", concept.alias("concept")), "problem_id"))


def concept_mastery_of(rows: DataFrame) -> DataFrame:
    """The same from attempts with their problems: user_id, subject, concept, correct."""
    out = rows.where("concept is not null").groupBy("user_id", "subject", "concept").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return out.withColumn("mastery", F.round(F.col("n_correct") / F.col("n"), 4))


def tag_counts(attempts: DataFrame, problems: DataFrame) -> DataFrame:
    """user_id, subject, tag, n: how often each mistake tag was given."""
    return tag_counts_of(attempts.join(problems.select("problem_id", "subject"), "problem_id"))


def tag_counts_of(rows: DataFrame) -> DataFrame:
    """The same from attempts with their problems: user_id, subject, mistakes."""
    return rows.select("user_id", "subject", F.explode("mistakes").alias("tag")).groupBy("user_id", "subject", "tag").agg(F.count("*").alias("n"))


def risk_tags(attempts: DataFrame, problems: DataFrame, mastery: DataFrame) -> DataFrame:
    """user_id, subject, tags: the three most frequent given tags, filled up with inferred ones that are not among them."""
    return tags_of(subject_state(attempts, problems), tag_counts(attempts, problems), mastery)


def tags_of(subjects: DataFrame, counts: DataFrame, mastery: DataFrame) -> DataFrame:
    """The same from what ``subject_state``, ``tag_counts`` and ``concept_mastery`` give."""
    rank = F.row_number().over(W.partitionBy("user_id", "subject").orderBy(F.desc("n"), "tag"))
    given = counts.withColumn("r", rank).where("r <= 3").groupBy("user_id", "subject").agg(F.array_sort(F.collect_list(F.struct("r", "tag"))).alias("top"))
    gaps = mastery.groupBy("user_id", "subject").agg(F.bool_or(F.col("mastery") < GAP_TAG_BELOW).alias("gap"))
    rows = subjects.join(given, ["user_id", "subject"], "left").join(gaps, ["user_id", "subject"], "left")
    return rows.select("user_id", "subject", _tags(F.col("top"), F.col("gap")).alias("tags"))


def _tags(top: Column, gap: Column) -> Column:
    """Three tags: those of ``top`` (an array of structs with tag, in order), then those that n_over, n_timed and gap say."""
    rate = F.coalesce(F.try_divide("n_over", "n_timed"), F.lit(0.0))
    none = F.array().cast("array<string>")
    inferred = F.concat(F.when(rate >= OVERRUN_TAG_FROM, F.array(F.lit("time_pressure"))).otherwise(none), F.when(gap, F.array(F.lit("concept_gap"))).otherwise(none))
    return F.slice(F.array_distinct(F.concat(F.coalesce(F.transform(top, lambda t: t["tag"]), none), inferred)), 1, 3)


def stage_of(n: Column, accuracy: Column) -> Column:
    """The learning stage of n attempts at an accuracy; a step holds while there are few attempts or the accuracy is low."""
    out = F.when(n == 0, "intro")
    for few, low, name in STAGES:
        out = out.when((n < few) | (accuracy < low), name)
    return out.otherwise("final")


def user_stage(attempts: DataFrame) -> DataFrame:
    """user_id, n, n_correct, stage."""
    out = attempts.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return out.withColumn("stage", stage_of(F.col("n"), F.col("n_correct") / F.col("n")))


def marked(problems: DataFrame, concept: Column) -> DataFrame:
    """problem_id, subject, concept, limit_seconds, known, own: problems as ``by_subject`` takes them after a left join. Of rows
    that repeat a problem_id one is its own, so that a learner's attempts are counted once."""
    own = F.row_number().over(W.partitionBy("problem_id").orderBy("subject", "limit_seconds")) == 1
    rows = problems.where("problem_id is not null").select("problem_id", "subject", concept.alias("concept"), "limit_seconds")
    return rows.withColumns({"known": F.lit(True), "own": own})


def by_subject(rows: DataFrame) -> DataFrame:
    """user_id, known, subject, what ``subject_state`` has, tags as ``risk_tags`` has them, concept_mastery (lowest first; null:
    none), mean_mastery, n_own, n_own_correct: all of a learner's state in one pass over attempts with their problems.

    rows: attempts left joined with ``marked`` problems. Attempts of unknown problems are rows with known false; their
    n_own count for the stage alone. Every attempt is counted under its concept and under each of its tags; where rows lie
    together by user_id (``tables.judged``), nothing here is shuffled."""
    known, own = F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("own", F.lit(True)).alias("own")
    over = (F.col("seconds") > F.col("limit_seconds")).alias("over")
    main = F.array(F.struct(F.lit(False).alias("given"), F.col("concept").alias("tag")))
    given = F.transform("mistakes", lambda t: F.struct(F.lit(True).alias("given"), t.alias("tag")))
    each = rows.select("user_id", known, "subject", own, "correct", "limit_seconds", over, F.inline(F.coalesce(F.concat(main, given), main)))
    sums = {
        "n": F.count("*"),
        "n_correct": F.count_if("correct"),
        "n_timed": F.count("limit_seconds"),
        "n_over": F.count_if("over"),
        "n_own": F.count_if("own"),
        "n_own_correct": F.count_if(F.col("own") & F.col("correct")),
    }
    counts = each.groupBy("user_id", "known", "subject", "given", "tag").agg(*(c.alias(k) for k, c in sums.items()))
    kind = F.when(F.col("given"), "tag").when(F.col("tag").isNotNull(), "concept")
    return _told(counts.withColumns({"kind": kind, "name": F.col("tag")}), ["user_id", "known", "subject"], {k: F.sum(F.when(~F.col("given"), F.col(k))) for k in sums})


def by_subject_of(counts: DataFrame) -> DataFrame:
    """The same (n_own and n_own_correct for all of a learner's attempts, in rows with known false) from counts: user_id, kind
    (user, subject, concept, tag), subject, name, n, n_correct, n_timed, n_over; one row a user_id, kind, subject and name."""
    whole, own = F.col("kind") == "subject", F.col("kind") == "user"
    sums = {k: F.sum(F.when(whole, F.col(k))) for k in ("n", "n_correct", "n_timed", "n_over")}
    sums |= {k: F.sum(F.when(own, F.col(c))) for k, c in (("n_own", "n"), ("n_own_correct", "n_correct"))}
    return _told(counts.withColumn("known", ~own), ["user_id", "known", "subject"], sums)


def _told(counts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums, tags and concept_mastery by ``keys`` from counts by keys, kind (concept, tag or another) and name."""
    mastery = F.when(F.col("kind") == "concept", F.round(F.col("n_correct") / F.col("n"), 4))
    out = counts.groupBy(*keys).agg(
        *(c.alias(k) for k, c in sums.items()),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "tag", F.struct((-F.col("n")).alias("n"), F.col("name").alias("tag"))))), 1, 3).alias("top"),
        F.array_sort(F.collect_list(F.when(mastery.isNotNull(), F.struct(mastery.alias("mastery"), F.col("name").alias("concept"))))).alias("concept_mastery"),
        F.avg(mastery).alias("mean_mastery"),
        F.bool_or(mastery < GAP_TAG_BELOW).alias("gap"),
    )
    keyed = F.col("user_id").isNotNull() & F.col("subject").isNotNull()  # a null key meets nothing, as in a join
    out = _rated(out).withColumn("tags", _tags(F.when(keyed, F.col("top")), keyed & F.col("gap")))
    return out.withColumn("concept_mastery", F.when(F.size("concept_mastery") > 0, F.col("concept_mastery"))).drop("top", "gap")


def user_state(attempts: DataFrame, problems: DataFrame, concept: Column) -> DataFrame:
    """One row a user: stage, and the subjects in ascending order with state, risk tags and mastery (lowest first)."""
    return user_state_of(by_subject(attempts.join(marked(problems, concept), "problem_id", "left")))


def user_state_of(states: DataFrame) -> DataFrame:
    """The same from what ``by_subject`` gives."""
    one = F.when(F.col("known") & F.col("subject").isNotNull(), F.struct("subject", "accuracy", "overrun", "tags", "concept_mastery"))
    out = states.where("user_id is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("subject_states"), F.sum("n_own").alias("n"), F.sum("n_own_correct").alias("n_correct"))
    return out.where(F.size("subject_states") > 0).select("user_id", "subject_states", stage_of(F.col("n"), F.col("n_correct") / F.col("n")).alias("stage"))


def nested(subjects: DataFrame, counts: DataFrame, mastery: DataFrame, stages: DataFrame) -> DataFrame:
    """The same from what ``subject_state``, ``tag_counts``, ``concept_mastery`` and ``user_stage`` give."""
    keys = ["user_id", "subject"]
    concepts = mastery.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("mastery", "concept"))).alias("concept_mastery"))
    rows = subjects.join(tags_of(subjects, counts, mastery), keys).join(concepts, keys, "left")
    states = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("subject", "accuracy", "overrun", "tags", "concept_mastery"))).alias("subject_states"))
    return states.join(stages.select("user_id", "stage"), "user_id")
