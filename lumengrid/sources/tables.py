"""The tables of a dataset folder, and the views of them that the engine's operators read.

A problem is a part, an attempt a line of an order, a learner a customer: see the README for the whole mapping.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many rows a task sorts or groups at once, where a step keeps all of its task's rows in memory.
ROWS_A_TASK = 250_000

#: Rows go to so many parts as they are read; for more (``spark.shuffle.sort.bypassMergeThreshold``) a task holds and sorts all
#: rows of its split of a file, some ten million, which only parts of more rows than the second figure would outweigh.
PARTS_AS_READ, ROWS_AS_READ = 200, 2_000_000


def dealt(rows: DataFrame, count: int, *keys: str, as_read: bool = False) -> DataFrame:
    """``rows``, by hash of ``keys`` in as many parts as ``count`` rows ask for, so that a task's memory does not grow with the
    table; as they are, where that is no more than the machines run at once. Joined sides take the same ``count``. ``as_read``
    is for rows of large files and a step that needs little memory a row: no more parts than can be written as rows are read."""
    at_once, parts = rows.sparkSession.sparkContext.defaultParallelism, math.ceil(count / ROWS_A_TASK)
    if parts <= at_once:
        return rows
    return rows.repartition(min(parts, max(PARTS_AS_READ, at_once, math.ceil(count / ROWS_AS_READ))) if as_read else parts, *keys)


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id, subject, unit, limit_seconds (null for one in ten: no time strategy), tags."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("problem_id"),
        F.col("p_type").alias("subject"),
        F.col("p_brand").alias("unit"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("limit_seconds"),
        F.split("p_name", " ").alias("tags"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, problem_id, attempt_at, correct, seconds, mistakes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    count = lines.count()  # from the footers of the files
    return dealt(lines, count, "l_orderkey", as_read=True).join(dealt(orders, count, "l_orderkey", as_read=True), "l_orderkey").select(
        "user_id",
        F.col("l_partkey").alias("problem_id"),
        F.col("l_shipdate").alias("attempt_at"),
        (F.col("l_returnflag") == "N").alias("correct"),
        F.col("l_quantity").alias("seconds"),
        F.array("l_returnflag", "l_linestatus").alias("mistakes"),
    )


def judged(spark: SparkSession, sf_dir: str, questions: DataFrame, how: str = "inner") -> DataFrame:
    """``attempts`` with the columns of ``questions`` (problem_id and more), dealt by learner: whatever is grouped or ranked by
    user_id and more needs no further shuffle, and no task meets more attempts than ``dealt`` gives it (or one learner has)."""
    rows, count = attempts(spark, sf_dir), table(spark, sf_dir, "lineitem").count()
    if questions.count() <= ROWS_A_TASK:
        joined = rows.join(F.broadcast(questions), "problem_id", how)
    else:
        joined = dealt(rows, count, "problem_id").join(dealt(questions, count, "problem_id"), "problem_id", how)
    return dealt(joined, count, "user_id")


#: The same two views for DuckDB.
PROBLEMS_SQL = """v_problem AS (
  SELECT p_partkey AS problem_id, p_type AS subject, p_brand AS unit,
         CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS limit_seconds, string_split(p_name, ' ') AS tags
  FROM part)"""
ATTEMPTS_SQL = """v_attempt AS (
  SELECT o_custkey AS user_id, l_partkey AS problem_id, l_shipdate AS attempt_at, l_returnflag = 'N' AS correct,
         l_quantity AS seconds, [l_returnflag, l_linestatus] AS mistakes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
VIEWS_SQL = f"{PROBLEMS_SQL}, {ATTEMPTS_SQL}"
