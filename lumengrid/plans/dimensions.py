"""Projections and checks over small dimensions: option rows, public fields, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.plans.registry import query
from lumengrid.sources.tables import table

ALLOWED = ["p_partkey", "p_name", "p_type"]


@query(f"SELECT {', '.join(ALLOWED)} FROM part")
def solver_input(spark, d) -> DataFrame:
    """The fields that a solver may see, by a list of what is allowed."""
    return table(spark, d, "part").select(*ALLOWED)


@query("SELECT p_partkey, coalesce(nullif(p_type, 'PROMO'), 'synthetic') AS source, p_size > 25 AS has_explanation, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'lossy' END AS flags FROM part")
def practice_brief(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("synthetic")).alias("source"), (F.col("p_size") > 25).alias("has_explanation"), F.when((F.col("p_size") % 5 == 0) | (F.col("p_size") % 7 == 0), "lossy").alias("flags"))


@query("WITH c AS (SELECT p_partkey, string_split(p_name, ' ') AS choices, p_size % 2 AS correct FROM part), e AS (SELECT p_partkey, unnest(choices) AS choice, unnest(range(len(choices))) AS pos, correct FROM c) SELECT p_partkey, pos::INT AS choice_index, choice, CASE WHEN pos = correct THEN 'keep' ELSE 'eliminate' END AS verdict FROM e")
def choice_elimination(spark, d) -> DataFrame:
    """A row for each choice: keep the right one, eliminate the others."""
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2).alias("correct"), F.posexplode(F.split("p_name", " ")).alias("choice_index", "choice"))
    return rows.select("p_partkey", "choice_index", "choice", F.when(F.col("choice_index") == F.col("correct"), "keep").otherwise("eliminate").alias("verdict"))


PATHS = ["structure", "choice_elimination", "reverse_check", "time_boxed"]


@query("SELECT p_partkey, path_type, 'Solve ' || p_name || ' by ' || path_type AS label, ord::INT AS ord FROM part, (VALUES " + ", ".join(f"('{p}', {i})" for i, p in enumerate(PATHS)) + ") AS v(path_type, ord)")
def solution_paths(spark, d) -> DataFrame:
    """Four solution paths for each problem, from a template."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.posexplode(F.array(*[F.lit(p) for p in PATHS])).alias("ord", "path_type"))
    return rows.select("p_partkey", "path_type", F.concat(F.lit("Solve "), "p_name", F.lit(" by "), "path_type").alias("label"), "ord")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 10 THEN 'too_short' WHEN l_returnflag = 'R' THEN 'no_answer' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL")
def validity_reasons(spark, d) -> DataFrame:
    """The first reason for which a record fails; null if it holds."""
    reason = F.when(F.col("l_quantity") < 10, "too_short").when(F.col("l_returnflag") == "R", "no_answer")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT s_suppkey AS ref FROM supplier WHERE s_suppkey * 50 NOT IN (SELECT p_partkey FROM part)")
def dangling_references(spark, d) -> DataFrame:
    """References to ids that do not exist."""
    refs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), (F.col("s_suppkey") * 50).alias("p_partkey")).distinct()
    return refs.join(table(spark, d, "part").select("p_partkey"), "p_partkey", "left_anti").select("ref")


@query("SELECT ref_type, ref_id, name FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'part' ELSE 'supplier' END AS ref_type, user_id AS ref_id, event_id FROM events) e JOIN (SELECT 'part' AS ref_type, p_partkey AS ref_id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) t USING (ref_type, ref_id)")
def evidence_resolution(spark, d) -> DataFrame:
    """References of several kinds against one tagged dimension."""
    refs = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "part").otherwise("supplier").alias("ref_type"), F.col("user_id").alias("ref_id"))
    parts = table(spark, d, "part").select(F.lit("part").alias("ref_type"), F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("name"))
    suppliers = table(spark, d, "supplier").select(F.lit("supplier").alias("ref_type"), F.col("s_suppkey").alias("ref_id"), F.col("s_name").alias("name"))
    return refs.join(parts.union(suppliers), ["ref_type", "ref_id"])


@query("SELECT o_custkey AS user_id, o_orderkey AS question_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def attempt_gated(spark, d) -> DataFrame:
    """What a learner has tried, and so may see."""
    tried = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(tried, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("question_id"))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN starts_with(p_name, 're') THEN 0 ELSE 1 END, p_partkey) AS position FROM part WHERE contains(p_name, 're')) SELECT p_partkey, p_name, position FROM r WHERE position <= 10")
def term_search(spark, d) -> DataFrame:
    """Names that hold a text, those that begin with it first (a top-ten report)."""
    order = [F.when(F.startswith("p_name", F.lit("re")), 0).otherwise(1), F.col("p_partkey")]
    from pyspark.sql import Window as W

    rows = table(spark, d, "part").where(F.contains("p_name", F.lit("re"))).orderBy(*order).limit(10)
    return rows.select("p_partkey", "p_name", F.row_number().over(W.orderBy(*order)).alias("position"))


@query("SELECT p_type AS exam, p_brand AS phase, count(*) AS n, count(DISTINCT p_size) AS sizes, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part GROUP BY ALL")
def exam_phase_counts(spark, d) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("exam"), F.col("p_brand").alias("phase")).agg(F.count("*").alias("n"), F.countDistinct("p_size").alias("sizes"), F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("names"))
