"""Learner state kept up to date by deltas: attempts come in, come again, and are corrected.

All of a learner's state (accuracy, overrun, mastery, tags, stage) follows from counts by subject, concept and tag. The
counts are kept as a table; a batch adds the counts of its new attempts and takes back those of the attempts that it
corrects, so old attempts are never gone through again. The log of attempts is append-only, cut into buckets by user, and a
batch reads the buckets of its own users alone, to tell new attempts from corrected and repeated ones. Log and counts carry
the number of their batch: a batch that runs again after a failure sees what was there before it, and replaces its own part.

Disk: a batch and the log it reads are dealt by user once, the log is written with what each attempt replaces, and the deltas
are told from there; facts are made where a learner's attempts lie, so one row an attempt is dealt and not one a fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumengrid.operators import state
from lumengrid.sources.folders import shuffles_dropped
from lumengrid.streaming.ingest import _bucket, _has_rows, _keep_last, _touched, read_state

GROUP = ["user_id", "kind", "subject", "name"]
SUMS = ["n", "n_correct", "n_timed", "n_over"]
SAID = ["problem_id", "correct", "seconds", "mistakes"]
COUNTS = StructType([StructField("user_id", LongType()), *(StructField(c, StringType()) for c in GROUP[1:]), *(StructField(c, LongType()) for c in SUMS)])


def counted(attempts: DataFrame, problems: DataFrame, concept: Column, old: DataFrame) -> DataFrame:
    """GROUP, n, n_correct, n_timed, n_over: the counts ``old`` and those of attempts (user_id, problem_id, correct, seconds,
    mistakes, sign), each as often as its sign says. Kinds: user; subject, concept and tag where the problem is known."""
    known = problems.select("problem_id", "subject", "limit_seconds", concept.alias("concept"), F.lit(True).alias("known"))
    none, unnamed = F.lit(0).cast("long"), F.lit(None).cast("string")
    sign = F.col("sign").cast("long")
    tests = {"right": F.col("correct"), "timed": F.col("limit_seconds").isNotNull(), "over": F.col("seconds") > F.col("limit_seconds")}
    told = attempts.join(known, "problem_id", "left").select("user_id", "sign", "known", "subject", "concept", "mistakes", *(c.alias(k) for k, c in tests.items()))
    right, timed, over = (F.when(F.col(c), sign).otherwise(none) for c in tests)

    def fact(kind: str, subject: Column, name: Column, n_timed: Column, n_over: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), name.alias("name"), sign.alias("n"), right.alias("n_correct"), n_timed.alias("n_timed"), n_over.alias("n_over"))

    subject = F.col("subject")
    facts = F.array(fact("user", unnamed, unnamed, none, none))
    more = F.array(fact("subject", subject, unnamed, timed, over))
    main = F.when(F.col("concept").isNotNull(), F.array(fact("concept", subject, F.col("concept"), none, none)))
    tags = F.transform(F.coalesce("mistakes", F.array().cast("array<string>")), lambda t: fact("tag", subject, t, none, none))
    nothing = F.slice(facts, 1, 0)
    every = F.concat(facts, F.when(F.col("known"), F.concat(more, F.coalesce(main, nothing), tags)).otherwise(nothing))
    held = old.select("user_id", F.struct(*GROUP[1:], *SUMS).alias("held"))
    rows = told.unionByName(held, allowMissingColumns=True).repartition("user_id")
    each = rows.select("user_id", F.inline(F.when(F.col("held").isNull(), every).otherwise(F.array("held"))))
    return each.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))


def changed(batch: DataFrame, held: DataFrame, key: str, order: str) -> DataFrame:
    """The batch's newest row of each key that is newer than the key's rows in ``held`` (of equal ones that which came first),
    with ``replaced``: what the newest of those says, null without one. A key belongs to one user."""
    row = F.struct(*batch.columns)
    both = batch.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True))).repartition("user_id")
    newest_row = F.max_by(row, F.struct(order, "_held"))
    old_row = F.max_by(F.when(F.col("_held"), F.struct(*SAID)), F.when(F.col("_held"), F.struct(order)))
    last = both.groupBy("user_id", key).agg(newest_row.alias("r"), F.max_by("_held", F.struct(order, "_held")).alias("_held"), old_row.alias("replaced"))
    return last.where(~F.col("_held")).select("r.*", "replaced")


def signed(log: DataFrame) -> DataFrame:
    """user_id, sign, SAID: attempts that count from now on and, with sign -1, those that they replace; none where both say the
    same."""

    def one(sign: int, of: str) -> Column:
        return F.struct(F.lit(sign).alias("sign"), *(F.col(f"{of}{c}").alias(c) for c in SAID))

    rows = log.where(~F.col("replaced").eqNullSafe(F.struct(*SAID)))
    return rows.select("user_id", F.inline(F.when(F.col("replaced").isNull(), F.array(one(1, ""))).otherwise(F.array(one(1, ""), one(-1, "replaced.")))))


def _replace(rows: DataFrame, path: str, number: str) -> None:
    """Writes the rows in place of what a failed run of the same batch left."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket", number).parquet(path)


def maintained(stream: DataFrame, problems: DataFrame, concept: Column, target: str, checkpoint: str, key: str = "log_id", order: str = "version", buckets: int = 64) -> StreamingQuery:
    """Keeps counts under ``target`` for a stream of attempts (user_id, ``key``, ``order``, problem_id, correct, seconds,
    mistakes). The newest row of a key by ``order`` counts (of equal ones that which came first), in whatever batches and
    sequence they come; a key belongs to one user. Runs over what is there, then ends; see ``current`` for the state."""
    log, counts = f"{target}/log", f"{target}/counts"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", _bucket(["user_id"], buckets))
        touched = _touched(batch)
        said = StructType([batch.schema[c] for c in SAID])
        schema = StructType([*batch.schema.fields, StructField("replaced", said), StructField("batch", LongType())])

        def logged() -> DataFrame:
            rows = spark.read.schema(schema).option("basePath", log).parquet(log) if _has_rows(spark, log) else spark.createDataFrame([], schema)
            return rows.where(F.col("bucket").isin(touched))

        with shuffles_dropped(spark):
            held = logged().where(F.col("batch") < number).drop("batch", "replaced")
            _replace(changed(batch, held, key, order).withColumn("batch", F.lit(number).cast("long")), log, "batch")
            old = read_state(spark, counts, COUNTS, before=number, only=touched)
            sums = counted(signed(logged().where(F.col("batch") == number)), problems, concept, old).where("n > 0")
            _replace(sums.withColumns({"bucket": _bucket(["user_id"], buckets), "version": F.lit(number).cast("long")}), counts, "version")
        for b in touched:
            _keep_last(spark, f"{counts}/bucket={b}", number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, target: str) -> DataFrame:
    """user_id, subject_states, stage: the state of every learner with a known problem, as ``state.user_state`` has it."""
    return state.user_state_of(state.by_subject_of(read_state(spark, f"{target}/counts", COUNTS).repartition("user_id")))
