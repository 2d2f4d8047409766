"""Streaming queries over the event table: a stream is run to its end, and its sink's rows are the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.plans.registry import query
from lumengrid.sources.folders import shared_folder
from lumengrid.sources.tables import table
from lumengrid.streaming import ingest


def _folder(spark) -> str:
    """A folder of this run under the folder that executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _replayed(spark, d, folder: str) -> DataFrame:
    """The events as a stream of three files: two parts, and the first once more."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for k in (0, 1, 0):
        events.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return ingest.event_stream(spark, f"{folder}/in", schema, 4)


@query("SELECT user_id, event_id, event_type FROM events")
def stream_dedup(spark, d) -> DataFrame:
    """A log that is fed some rows twice holds each once."""
    folder = _folder(spark)
    ingest.append_once(_replayed(spark, d, folder), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/log").select("user_id", "event_id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest_state(spark, d) -> DataFrame:
    """The newest event of each user after all batches."""
    folder = _folder(spark)
    stream = _replayed(spark, d, folder)
    ingest.latest_state(stream, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return ingest.read_state(spark, f"{folder}/state", stream.schema).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def stream_gate(spark, d) -> DataFrame:
    """Rows of unknown keys are turned away at the gate."""
    folder = _folder(spark)
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    ingest.append_once(ingest.known_only(_replayed(spark, d, folder), known, "user_id"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/log").select("user_id", "event_id")
