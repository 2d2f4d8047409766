"""Grading and comparing answers: grouped accuracy, quality, votes, stability, pass status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_accuracy(scores: DataFrame, sets: list[list[str]]) -> DataFrame:
    """level (which set), key (its values joined by /), total, n_correct, accuracy: all sets from one pass. A null in a key
    leaves the row out of that set. scores: the sets' columns and correct."""
    names = sorted({c for s in sets for c in s})
    rows = scores.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(
        F.grouping_id().alias("g"), F.count("*").alias("total"), F.count_if("correct").alias("n_correct")
    )
    bit = {c: 1 << (len(names) - 1 - i) for i, c in enumerate(names)}
    level, key, whole = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for s in sets:
        here = F.col("g") == sum(b for c, b in bit.items() if c not in s)
        level = F.when(here, "/".join(s) or "all").otherwise(level)
        key = F.when(here, F.concat_ws("/", *s) if s else F.lit("all")).otherwise(key)
        full = F.lit(True)
        for c in s:
            full = full & F.col(c).isNotNull()
        whole = F.when(here, full).otherwise(whole)
    return rows.where(whole).select(level.alias("level"), key.alias("key"), "total", "n_correct", F.round(F.col("n_correct") / F.col("total"), 4).alias("accuracy"))


def pass_status(scores: DataFrame, subject: str, by: list[str], each: float = 0.40, overall: float = 0.60) -> DataFrame:
    """by, n_subjects, passed: every subject at ``each`` or more and the whole at ``overall`` or more."""
    subjects = scores.groupBy(*by, subject).agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    out = subjects.groupBy(*by).agg(F.count("*").alias("n_subjects"), F.bool_and(F.col("c") / F.col("n") >= each).alias("all"), (F.sum("c") / F.sum("n")).alias("rate"))
    return out.select(*by, "n_subjects", F.coalesce(F.col("all") & (F.col("rate") >= overall), F.lit(False)).alias("passed"))


def plurality(votes: DataFrame, by: list[str]) -> DataFrame:
    """by, choice, n_top, n_valid, unanimous. votes: by, voter_order, choice (null or -1: no vote). Ties go to the choice
    of the first voter; without a vote the choice is -1. unanimous: every voter voted, and alike."""
    valid = F.col("choice").isNotNull() & (F.col("choice") != -1)
    counts = votes.where(valid).groupBy(*by, "choice").agg(F.count("*").alias("n"), F.min("voter_order").alias("first"))
    best = counts.groupBy(*by).agg(F.max_by("choice", F.struct("n", -F.col("first"))).alias("choice"), F.max("n").alias("n_top"), F.sum("n").alias("n_valid"))
    all_voters = votes.groupBy(*by).agg(F.count("*").alias("n_all"))
    return all_voters.join(best, by, "left").select(
        *by, F.coalesce("choice", F.lit(-1)).alias("choice"), F.coalesce("n_top", F.lit(0)).alias("n_top"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
        F.coalesce(F.col("n_top") == F.col("n_all"), F.lit(False)).alias("unanimous"),
    )


def stability(runs: DataFrame, key: str) -> DataFrame:
    """key, n_runs, n_ok, class (all, none, mixed), majority (more than half right). runs: key, ok."""
    out = runs.groupBy(key).agg(F.count("*").alias("n_runs"), F.count_if("ok").alias("n_ok"))
    kind = F.when(F.col("n_ok") == F.col("n_runs"), "all").when(F.col("n_ok") == 0, "none").otherwise("mixed")
    return out.withColumns({"class": kind, "majority": 2 * F.col("n_ok") > F.col("n_runs")})


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, n_runs, mean, deviation: of the runs' rounded accuracies, population deviation. runs: by, run, ok."""
    each = runs.groupBy(*by, "run").agg(F.round(F.count_if("ok") / F.count("*"), 4).alias("accuracy"))
    return each.groupBy(*by).agg(F.count("*").alias("n_runs"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("deviation"))


def breaker(rows: DataFrame, by: list[str], order: list[str], limit: int = 5) -> DataFrame:
    """The rows up to the end of the first run of ``limit`` errors (column failed); all rows where there is none."""
    w = W.partitionBy(*by).orderBy(*order)
    island = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w)
    rows = rows.withColumn("_island", island)
    run = F.sum(F.col("failed").cast("int")).over(W.partitionBy(*by, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_tripped", (run >= limit).cast("int"))
    before = F.coalesce(F.sum("_tripped").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where("_before = 0").drop("_island", "_tripped", "_before")
