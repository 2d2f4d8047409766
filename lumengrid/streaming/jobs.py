"""Long work over a stream of items, one result for each: resumable, with errors retried, counted and never kept as results.

Each item is a key of a state. What is done is remembered there, so an item that comes again, or a run that starts again from
its checkpoint, does no work twice. A backend's error is not a result: it goes to a table of its own, and a timer brings the
item back until it has had ``most_attempts``. An item that has used them up stays open, and gets them anew when it is fed
again. State and timers live in the checkpoint, results and errors in tables with a part for each batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lumengrid.streaming.ingest import _has_rows

OUT = "item string, attempt int, status string, result string, again boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BACKEND_ERROR = "backend_error"
#: A run ends after so many batches in a row without new items (the first ones may be those of the run before).
IDLE = 4


class _Attempts(StatefulProcessor):
    """State of an item: its payload, the attempts it has had, whether it is done."""

    def __init__(self, work: Callable[[str, str, int], tuple[str, str | None]], most_attempts: int, wait_ms: int):
        self.work, self.most, self.wait = work, most_attempts, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "payload string, attempts int, done boolean")

    def _tried(self, item: str, payload: str, before: int, had: int) -> Row:
        """One attempt, the ``had + 1``-th of this round and the ``before + 1``-th of all."""
        status, result = self.work(item, payload, before + 1)
        failed = status == BACKEND_ERROR
        again = failed and had + 1 < self.most
        self.state.update((payload, had + 1, not failed))
        if again:
            self.handle.registerTimer(int(time.time() * 1000) + self.wait)
        return Row(item=item, attempt=had + 1, status=status, result=None if failed else result, again=again)

    def handleInputRows(self, key, rows, timerValues):
        payload = [r["payload"] for r in rows][-1]
        held = self.state.get()
        if held is None:
            yield self._tried(key[0], payload, 0, 0)
        elif not held[2] and held[1] >= self.most:  # given up before, and fed again
            yield self._tried(key[0], payload, held[1], 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        payload, had, done = self.state.get()
        if not done:
            yield self._tried(key[0], payload, had, had)

    def close(self) -> None:
        pass


def _table(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType([*spark.createDataFrame([], OUT).schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(path) if _has_rows(spark, path) else spark.createDataFrame([], schema)


def results(spark: SparkSession, target: str) -> DataFrame:
    """item, attempt, status, result, batch: one row for each item that is done."""
    return _table(spark, f"{target}/results").drop("again")


def errors(spark: SparkSession, target: str) -> DataFrame:
    """item, attempt, status, again, batch: one row for each attempt that failed; ``again``: another one was to follow."""
    return _table(spark, f"{target}/errors").drop("result")


def _gone(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _open(rows: DataFrame) -> int:
    """Items that wait for a timer, by rows of attempts: those that wait since their first, less those that are through."""
    waits = F.count_if((F.col("attempt") == 1) & F.col("again"))
    through = F.count_if((F.col("attempt") > 1) & ~F.col("again"))
    found = rows.agg((waits - through).alias("n")).first()
    return found["n"] or 0


def run(items: DataFrame, work: Callable[[str, str, int], tuple[str, str | None]], target: str, checkpoint: str, most_attempts: int = 3, wait_ms: int = 0, limit_s: float = 3600.0) -> dict[str, int]:
    """Works through a stream of items (item, payload: strings) until none is new and none waits, or ``limit_s`` is over (the
    next run goes on from there). ``work(item, payload, attempt)`` gives (status, result); BACKEND_ERROR is retried. Returns
    how many attempts of this run ended in each status."""
    spark = items.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    waiting = _open(_table(spark, f"{target}/results").unionByName(_table(spark, f"{target}/errors")))
    seen = {"open": waiting, "counts": {}}

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number).cast("long"))
        batch.persist()
        failed = F.col("status") == BACKEND_ERROR
        for part, name in ((batch.where(~failed), "results"), (batch.where(failed), "errors")):
            _gone(spark, f"{target}/{name}/batch={number}")  # of a batch that runs again, whose work may end otherwise now
            if part.limit(1).count():
                part.write.mode("append").partitionBy("batch").parquet(f"{target}/{name}")
        counts = {r["status"]: r["n"] for r in batch.groupBy("status").agg(F.count("*").alias("n")).collect()}
        for status, n in counts.items():
            seen["counts"][status] = seen["counts"].get(status, 0) + n
        seen["open"] += _open(batch)
        batch.unpersist()

    attempts = items.groupBy("item").transformWithState(_Attempts(work, most_attempts, wait_ms), OUT, "Append", "ProcessingTime")
    query = attempts.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).start()
    began = time.time()
    try:
        while time.time() - began < limit_s:
            if query.exception():
                raise query.exception()
            last = query.recentProgress[-IDLE:]  # timers keep batches coming, with rows or without
            if len(last) == IDLE and not any(p["numInputRows"] for p in last) and seen["open"] <= 0:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    return seen["counts"]
