"""Live ingest of attempt logs with Structured Streaming.

The log is append-only and must hold each (user, log id) once, for ever. So the gate to the log is an anti-join with what the
log already holds, made in ``foreachBatch``; a watermark would forget old keys. Log and state are cut into ``buckets`` by a
hash of the key, and a batch reads and writes only the buckets of its own keys. Batches carry their number, so a batch that
runs again after a failure replaces its own partitions and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lumengrid.sources.sinks import inserted_or_ignored, upserted

KEY = ["user_id", "event_id"]


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def known_only(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The stream's rows whose key the static table holds (a stream-static semi join)."""
    return stream.join(known.select(key).distinct(), key, "left_semi")


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _touched(batch: DataFrame) -> list[int]:
    """The buckets of a batch: a list that their number bounds."""
    return sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())


def append_once(stream: DataFrame, log: str, checkpoint: str, key: list[str] | None = None, order: str = "event_id", buckets: int = 64) -> StreamingQuery:
    """Appends to the log at ``log`` the first row of each key that it lacks; runs over what is there, then ends."""
    key = key or KEY

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", _bucket(key, buckets))
        schema = StructType([*batch.schema.fields, StructField("batch", LongType())])
        held = spark.read.schema(schema).option("basePath", log).parquet(log) if _has_rows(spark, log) else spark.createDataFrame([], schema)
        held = held.where(F.col("bucket").isin(_touched(batch)) & (F.col("batch") != number)).drop("batch")
        new = inserted_or_ignored(held, batch, key, order)
        new.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(log)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(stream: DataFrame, target: str, checkpoint: str, key: str = "user_id", order: str = "event_id", buckets: int = 64) -> StreamingQuery:
    """Keeps one row a key at ``target``: the newest. A batch writes a new version of its own buckets beside the old ones;
    a version's number is the batch's, and readers take the highest of each bucket (``read_state``), so a failed batch
    leaves the last state whole. Versions before the last are deleted with the next batch that touches their bucket."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", _bucket([key], buckets))
        touched = _touched(batch)
        plain = StructType([f for f in batch.schema.fields if f.name != "bucket"])
        old = read_state(spark, target, plain, before=number, only=touched).withColumn("bucket", _bucket([key], buckets))
        new = upserted(old, newest(batch.unionByName(old), key, order), [key], order).withColumn("version", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        for b in touched:
            _keep_last(spark, f"{target}/bucket={b}", number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keep_last(spark: SparkSession, folder: str, number: int) -> None:
    """Deletes versions of a bucket but the one of ``number`` and the one before it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return
    older = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("version="))
    for _, path in [x for x in older if x[0] < number][:-1]:
        fs.delete(path, True)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def read_state(spark: SparkSession, target: str, schema, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The newest version of each bucket (of versions under ``before``, of the buckets ``only``, where given)."""
    if not _has_rows(spark, target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("version", LongType())])).parquet(target)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(only))
    last = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
    return rows.join(F.broadcast(last), ["bucket", "version"]).drop("bucket", "version")


def counts_by_minute(stream: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Requests of each type in each minute; rows later than ``late`` are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 minute"), "event_type").agg(F.count("*").alias("n"))


def running_state(stream: DataFrame) -> DataFrame:
    """Sums and counts of each user, for ``update`` mode: the full state without a second look at old rows."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _has_rows(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))
