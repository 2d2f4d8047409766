"""State kept by deltas equals state from all attempts, whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from lumengrid.operators import state
from lumengrid.streaming import ingest, learner

LOG = "user_id long, log_id long, version int, problem_id string, correct boolean, seconds int, mistakes array<string>"
PROBLEMS = [("p1", "tax", 60, "c1"), ("p2", "tax", None, "c2"), ("p3", "law", 90, None), ("p4", "law", 30, "c3")]


def plain(rows):
    return sorted((r["user_id"], r["stage"], str(r["subject_states"])) for r in rows.collect())


def history(seed):
    """(rows in the order they come, the row of each key that counts)."""
    rng = random.Random(seed)
    rows, last = [], {}
    for log_id in range(120):
        for version in range(rng.choice([1, 1, 2, 3])):
            rows.append((log_id % 9, log_id, version, rng.choice(["p1", "p2", "p3", "p4", "gone"]), rng.choice([True, False, None]), rng.choice([20, 70, None]), rng.choice([[], ["a"], ["a", "b"], ["b", "b"], None])))
    for r in rows:
        last[r[1]] = max(last.get(r[1], r), r, key=lambda x: x[2])
    return rng.sample(rows + rng.sample(rows, 40), len(rows) + 40), list(last.values())


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 4), (3, 6)])
def test_state_by_deltas(spark, tmp_path, seed, batches):
    rows, final = history(seed)
    problems = spark.createDataFrame(PROBLEMS, "problem_id string, subject string, limit_seconds int, concept string")
    src, target, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):  # a run for every file: the query stops and starts again
        spark.createDataFrame(rows[k : k + size], LOG).coalesce(1).write.mode("append").parquet(src)
        learner.maintained(ingest.event_stream(spark, src, LOG), problems, F.col("concept"), target, mark, buckets=4).awaitTermination()
    whole = state.user_state(spark.createDataFrame(final, LOG), problems, F.col("concept"))
    assert plain(learner.current(spark, target)) == plain(whole)


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    """The second batch is lost after its tables are written, before the stream knows: it runs again."""
    import shutil

    rows, final = history(7)
    problems = spark.createDataFrame(PROBLEMS, "problem_id string, subject string, limit_seconds int, concept string")
    src, target, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    for k, part in enumerate((rows[:80], rows[80:])):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
        learner.maintained(ingest.event_stream(spark, src, LOG), problems, F.col("concept"), target, mark, buckets=4).awaitTermination()
    once = plain(learner.current(spark, target))
    for name in ("1", ".1.crc"):
        if (tmp_path / "mark" / "commits" / name).exists():
            (tmp_path / "mark" / "commits" / name).unlink()
    learner.maintained(ingest.event_stream(spark, src, LOG), problems, F.col("concept"), target, mark, buckets=4).awaitTermination()
    assert plain(learner.current(spark, target)) == once == plain(state.user_state(spark.createDataFrame(final, LOG), problems, F.col("concept")))
    shutil.rmtree(src)


def test_a_stream_deals_an_attempt_once_a_step(spark, tmp_path):
    """Every fact of an attempt was dealt, and the log four times a batch (6 GB: no disk left)."""
    problems = spark.range(100).select(F.col("id").alias("problem_id"), F.lit("tax").alias("subject"), F.lit(60).alias("limit_seconds"), F.concat(F.lit("concept "), "id").alias("concept"))
    src, target, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    mistakes = F.array(F.concat(F.lit("mistake "), F.col("id") % 900), F.lit("b"))
    log = spark.range(20_000).select((F.col("id") % 5000).alias("user_id"), F.col("id").alias("log_id"), (F.col("id") * 7 % 100).alias("problem_id"), F.lit(50).alias("seconds"), mistakes.alias("mistakes"))
    for version in (0, 1):
        rows = log.select("*", F.lit(version).alias("version"), (F.col("log_id") % 5 >= version).alias("correct"))
        rows.coalesce(1).write.mode("append").parquet(src)
    stream = ingest.event_stream(spark, src, rows.schema)
    before = _shuffled(spark)
    learner.maintained(stream, problems, F.col("concept"), target, mark, buckets=4).awaitTermination()
    assert (_shuffled(spark) - before) / 40_000 < 100  # 58; 212 before
    assert plain(learner.current(spark, target)) == plain(state.user_state(rows, problems, F.col("concept")))


def _shuffled(spark):
    """Bytes that all tasks so far have written to be shuffled."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()
