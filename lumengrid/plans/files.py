"""Queries of sources and sinks: rows of the tables go out as files of the engine's formats and are read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions.text import main_concept, surface_forms
from lumengrid.operators.prescribe import task_subject
from lumengrid.plans.live import _folder, _replayed
from lumengrid.plans.registry import query
from lumengrid.sources import readers, sinks
from lumengrid.sources.tables import table
from lumengrid.streaming import ingest

NATION = "question_id string, subject string, n int"


def _questions(spark, d, plus: Column | None = None) -> DataFrame:
    key = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.concat(F.lit("q"), key.cast("string")).alias("question_id"), F.when(key % 2 == 0, "tax").otherwise("law").alias("subject"), key.cast("int").alias("n"))
    return rows if plus is None else rows.withColumn("n", F.col("n") + plus)


def _one_file_each(rows: DataFrame, path: str) -> None:
    """One JSON document a file: the few rows are dealt out by range."""
    rows.repartitionByRange(rows.count(), "n").write.json(path)


@query("SELECT 'q' || n_nationkey AS question_id, CASE WHEN n_nationkey % 2 = 0 THEN 'tax' ELSE 'law' END AS subject, n_nationkey::INT AS n, CASE WHEN n_nationkey < 10 THEN 2020 WHEN n_nationkey < 20 THEN 2021 ELSE 2022 END AS year FROM nation")
def scan_year_files(spark, d) -> DataFrame:
    """Questions under a folder for each year."""
    folder, rows = _folder(spark), _questions(spark, d)
    _one_file_each(rows.where("n < 10"), f"{folder}/2020")
    _one_file_each(rows.where("n between 10 and 19"), f"{folder}/2021")
    _one_file_each(rows.where("n >= 20"), f"{folder}/2022")
    return readers.year_files(spark, folder, NATION).select("question_id", "subject", "n", "year")


@query("SELECT 'q' || n_nationkey AS question_id, (n_nationkey + CASE WHEN n_nationkey < 5 THEN 100 ELSE 0 END)::INT AS n FROM nation")
def scan_indexed(spark, d) -> DataFrame:
    """Files at any depth by id; of two with one id, the last path wins."""
    folder = _folder(spark)
    _one_file_each(_questions(spark, d), f"{folder}/a/deep")
    _one_file_each(_questions(spark, d, F.lit(100)).where("n < 105"), f"{folder}/b")
    return readers.indexed(spark, folder, NATION, "question_id").select("question_id", "n")


@query("SELECT 'q' || c_custkey AS question_id, c_mktsegment AS subject, c_nationkey::INT AS n FROM customer")
def scan_listed(spark, d) -> DataFrame:
    """Questions from files of top-level arrays, all named in one text."""
    folder = _folder(spark)
    rows = table(spark, d, "customer").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("question_id"), F.col("c_mktsegment").alias("subject"), F.col("c_nationkey").cast("int").alias("n"))
    arrays = rows.groupBy("n", F.pmod(F.xxhash64("question_id"), F.lit(16)).alias("part")).agg(F.to_json(F.collect_list(F.struct("question_id", "subject", "n"))).alias("value"))
    for low in (0, 10, 20):  # an array a file: a writer's line is a document
        own = arrays.where(F.col("n").between(low, low + 9))
        own.repartition(max(1, own.count()), "n", "part").where("value IS NOT NULL").select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/{low}")
    return readers.listed_arrays(spark, f" {folder}/0, {folder}/10,,{folder}/20 ,{folder}/0", NATION).select("question_id", "subject", "n")


@query("SELECT doc_id, CASE WHEN source LIKE '%3' THEN 'tax' WHEN source LIKE '%5' THEN 'law' END AS subject, CASE WHEN source NOT LIKE '%3' AND source NOT LIKE '%5' THEN 'no_subject' WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 500 THEN 'scanned' END AS skipped FROM documents")
def readable_texts(spark, d) -> DataFrame:
    """Texts with the subject that their file's name tells, and why some go no further."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return readers.readable(docs, F.when(F.col("source").endswith("3"), "tax").when(F.col("source").endswith("5"), "law")).select("doc_id", "subject", "skipped")


@query("SELECT r_regionkey::INT AS id, r_name AS title FROM region")
def scan_nested_array(spark, d) -> DataFrame:
    """Rows of a top-level array; a missing file and a null array have none."""
    folder = _folder(spark)
    rows = table(spark, d, "region").agg(F.collect_list(F.struct(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("title"))).alias("tutorials"))
    rows.write.json(f"{folder}/full")
    spark.createDataFrame([(None,)], "tutorials array<struct<id:int,title:string>>").write.option("ignoreNullFields", False).json(f"{folder}/empty")
    element = "id int, title string"
    found = [readers.nested_array(spark, f"{folder}/{p}", "tutorials", element.replace(" int", ":int").replace(" string", ":string")) for p in ("full", "empty", "missing")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT 'c' || n_nationkey AS chunk_id, n_name AS text, 'title ' || n_regionkey AS source_title, CASE WHEN n_nationkey % 2 = 0 THEN 'ref' END AS source_reference FROM nation")
def scan_chunks(spark, d) -> DataFrame:
    """Chunks with the fields of their source beside them."""
    folder, key = _folder(spark), F.col("n_nationkey")
    source = F.struct(F.concat(F.lit("title "), F.col("n_regionkey").cast("string")).alias("title"), F.when(key % 2 == 0, "ref").alias("reference"))
    _one_file_each(table(spark, d, "nation").select(F.concat(F.lit("c"), key.cast("string")).alias("chunk_id"), F.col("n_name").alias("text"), source.alias("source"), key.alias("n")), folder)
    return readers.chunks(spark, folder).select("chunk_id", "text", "source_title", "source_reference")


@query("SELECT p_brand AS from_term, 'problem' AS to_kind, p_partkey::VARCHAR AS to_id, 'tested_in' AS relation, p_size::DOUBLE AS weight, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS evidence FROM part")
def scan_edge_lines(spark, d) -> DataFrame:
    """Edges as canonical lines with blank and broken ones among them; a missing file is empty."""
    folder = _folder(spark)
    edges = table(spark, d, "part").select(F.col("p_brand").alias("from_term"), F.lit("problem").alias("to_kind"), F.col("p_partkey").cast("string").alias("to_id"), F.lit("tested_in").alias("relation"), F.col("p_size").cast("double").alias("weight"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("evidence"))
    lines = edges.select(F.concat(F.lit('{"from_term": "'), "from_term", F.lit('", "to_kind": "problem", "to_id": "'), "to_id", F.lit('", "relation": "tested_in", "weight": '), F.col("weight").cast("string"), F.coalesce(F.concat(F.lit(', "evidence": "'), "evidence", F.lit('"')), F.lit("")), F.lit("}")).alias("value"))
    lines.union(spark.createDataFrame([("",), ("{broken",), ("   ",)], "value string")).write.text(f"{folder}/edges")
    return readers.edges(spark, f"{folder}/edges").unionByName(readers.edges(spark, f"{folder}/missing"))


@query("SELECT s_suppkey::INT AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN -1 WHEN s_suppkey % 5 = 0 THEN -1 ELSE s_nationkey END::INT AS points FROM supplier")
def scan_csv(spark, d) -> DataFrame:
    """CSV with a byte-order mark; integers that are empty or no numbers take a default."""
    folder, key = _folder(spark), F.col("s_suppkey")
    points = F.when(key % 3 == 0, "").when(key % 5 == 0, "n/a").otherwise(F.col("s_nationkey").cast("string"))
    rows = table(spark, d, "supplier").select(key.cast("string").alias("\ufeffid"), F.col("s_name").alias("name"), points.alias("points"))
    rows.write.option("header", True).option("emptyValue", "").csv(folder)  # every part begins with the mark
    return readers.csv_with_header(spark, folder, "id int, name string, points int", {"points": -1})


@query("SELECT r_regionkey AS id, r_name AS name, 1 AS run FROM region UNION ALL SELECT n_nationkey, n_name, 2 FROM nation UNION ALL SELECT n_nationkey, n_name, 2 FROM nation WHERE n_nationkey < 3")
def refreshed_and_appended(spark, d) -> DataFrame:
    """A table that is refreshed holds the last rows alone; runs are appended to it."""
    folder = _folder(spark)
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(2).alias("run"))
    sinks.refresh(nations, folder)
    sinks.refresh(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("run")), folder)
    sinks.append(nations, folder)
    sinks.append(nations.where("id < 3"), folder)
    return spark.read.parquet(folder)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'filled' ELSE p_name END AS name FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def merged_fill(spark, d) -> DataFrame:
    """A base with rows of a second pass in place of, or beside, its own."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return readers.merged(parts.where("p_partkey % 2 = 0"), parts.where("p_partkey % 3 = 0").withColumn("name", F.lit("filled")), "p_partkey")


@query(
    """SELECT p_partkey, array_to_string(list_filter([string_split(p_name, ' ')[1], p_brand, 'x'], lambda f: length(f) >= 2), '|') AS forms, CASE WHEN p_partkey % 2 = 0 THEN 'tag:' || p_brand END AS concept,
  CASE p_size % 3 WHEN 0 THEN 'tax' WHEN 1 THEN 'mixed' ELSE 'mixed' END AS task FROM part"""
)
def term_forms(spark, d) -> DataFrame:
    """Surface forms of two letters or more, the first tag with a colon, the one subject that a rule and a learner share."""
    key, n = F.col("p_partkey"), F.col("p_size") % 3
    tags = F.array(F.lit("plain"), F.when(key % 2 == 0, F.concat(F.lit("tag:"), "p_brand")).otherwise("other"), F.lit("plain2"))
    own = F.when(n == 1, F.array(F.lit("tax"), F.lit("law"))).when(n == 0, F.array(F.lit("tax"))).otherwise(F.array(F.lit("audit")))
    forms = surface_forms(F.get(F.split("p_name", " "), F.lit(0)), F.array(F.col("p_brand"), F.lit("x")))
    return table(spark, d, "part").select(key, F.array_join(forms, "|").alias("forms"), main_concept(tags).alias("concept"), task_subject(own, F.array(F.lit("tax"), F.lit("law"))).alias("task"))


def _completed(spark, stream: DataFrame, folder: str) -> DataFrame:
    """The whole result of a streaming aggregate after its last batch."""
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


FED = "fed AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 2 = 0)"


@query(f"WITH {FED} SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM fed GROUP BY user_id")
def stream_running_state(spark, d) -> DataFrame:
    """Counts and sums of each user over all that was fed, rows that came twice among it."""
    folder = _folder(spark)
    return _completed(spark, ingest.running_state(_replayed(spark, d, folder)), folder).select("user_id", "n", F.round("total", 4).alias("total"))


@query(f"WITH {FED} SELECT floor(epoch(ts) / 60)::BIGINT AS minute, event_type, count(*) AS n FROM fed GROUP BY ALL")
def stream_minute_counts(spark, d) -> DataFrame:
    """Requests of each type in each minute."""
    folder = _folder(spark)
    rows = _completed(spark, ingest.counts_by_minute(_replayed(spark, d, folder), late="10000 days"), folder)
    minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', cast(window.start as timestamp_ntz))")
    return rows.select(minute.alias("minute"), "event_type", "n")
