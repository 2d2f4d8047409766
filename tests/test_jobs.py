"""Resumable work over a stream: errors are retried by timers, counted, and never kept as results."""

from pyspark.sql import functions as F

from lumengrid.streaming import jobs


def backend():
    """Items ending in 3 fail once, in 7 always; all others are done at once."""

    def work(item, payload, attempt):
        if item.endswith("7") or (item.endswith("3") and attempt < 2):
            return "backend_error", "half a result"
        return ("verified" if payload == "a" else "mismatch"), f"{item}:{payload}"

    return work


def feed(spark, folder, low, high):
    ids = spark.range(low, high).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("item"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("payload"))
    ids.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("item string, payload string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_killed_and_restarted_run_gives_the_rows_of_one_run(spark, tmp_path):
    work = backend()
    src, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    feed(spark, src, 0, 15)
    jobs.run(stream(spark, src), work, target, mark, limit_s=0.0)  # stopped before it is through
    feed(spark, src, 10, 30)  # ten to fourteen come again
    jobs.run(stream(spark, src), work, target, mark, limit_s=90)
    done = {r["item"]: (r["status"], r["result"]) for r in jobs.results(spark, target).collect()}
    assert jobs.results(spark, target).count() == len(done)  # each once
    assert done == {f"q{k}": work(f"q{k}", "ab"[k % 2], 2) for k in range(30) if k % 10 != 7}
    failed = sorted((r["item"], r["attempt"], r["again"]) for r in jobs.errors(spark, target).collect())
    assert failed == sorted([(f"q{k}", 1, True) for k in (3, 13, 23)] + [(f"q{k}", n, n < 3) for k in (7, 17, 27) for n in (1, 2, 3)])
    again = jobs.run(stream(spark, src), work, target, mark, limit_s=60)  # nothing new, nothing to do
    assert again == {} and jobs.results(spark, target).count() == 27
