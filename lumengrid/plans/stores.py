"""What tables hold after writes: upserts, ignored repeats, active rows, pages, overlays, policies, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.operators.warehouse import policy
from lumengrid.plans.registry import query
from lumengrid.sources import sinks
from lumengrid.sources.tables import table


@query("WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, min(event_id) OVER (PARTITION BY user_id) AS created FROM events) SELECT user_id, event_id, value, created FROM n WHERE r = 1")
def upsert_latest(spark, d) -> DataFrame:
    """One state a user: the last event's, with the first event kept as its creation. The log's halves are target and batch."""
    events = table(spark, d, "events").select("user_id", "event_id", "value", F.col("event_id").alias("created"))
    first = events.where("event_id % 2 = 0")
    target = sinks.upserted(first.limit(0), first, ["user_id"], "event_id")
    created = events.groupBy("user_id").agg(F.min("event_id").alias("created"))
    target = target.drop("created").join(created, "user_id").select("user_id", "event_id", "value", "created")
    batch = events.join(target.select("user_id", F.col("event_id").alias("seen")), "user_id", "left").where("seen is null or event_id >= seen").drop("seen", "created").join(created, "user_id")
    return sinks.upserted(target, batch.select("user_id", "event_id", "value", "created"), ["user_id"], "event_id", ["created"])


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE n = 1 AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5)")
def insert_ignore(spark, d) -> DataFrame:
    """The rows that an insert-or-ignore adds: the first of each key that the target lacks. All lines are offered."""
    lines = table(spark, d, "lineitem")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    batch = lines.withColumn("o", order)
    return sinks.inserted_or_ignored(lines.where("l_quantity < 5"), batch, ["l_orderkey", "l_linenumber"], "o").select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH w AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) SELECT user_id, event_type, event_id FROM w WHERE n = 1")
def idempotent_log(spark, d) -> DataFrame:
    """A log without repeats of (user, type, properties)."""
    events = table(spark, d, "events")
    return sinks.inserted_or_ignored(events.limit(0), events, ["user_id", "event_type", "props"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT o_custkey AS user_id, o_orderkey AS prescription_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_active FROM orders")
def active_prescription(spark, d) -> DataFrame:
    """The newest prescription of each user is the active one."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("prescription_id"), "o_orderdate")
    return sinks.activated(rows, "user_id", [F.desc("o_orderdate"), F.desc("prescription_id")]).drop("o_orderdate")


@query("SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def override_previous(spark, d) -> DataFrame:
    """Each override with the value it replaces."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", "value", F.lag("value").over(w).alias("previous"))


@query("WITH p AS (SELECT p_partkey, p_name FROM part WHERE p_partkey > 40 ORDER BY p_partkey LIMIT 25) SELECT p_partkey, p_name, CASE WHEN (SELECT count(*) FROM p) = 25 THEN (SELECT max(p_partkey) FROM p) END AS next_after FROM p")
def keyset_page(spark, d) -> DataFrame:
    """A page of 25 after a key; the cursor is the last key if the page is full."""
    page = table(spark, d, "part").where("p_partkey > 40").orderBy("p_partkey").limit(25).select("p_partkey", "p_name")
    whole = W.partitionBy(F.lit(0))
    return page.withColumn("next_after", F.when(F.count("*").over(whole) == 25, F.max("p_partkey").over(whole)))


@query("SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE p_name END AS name, CASE WHEN s_suppkey IS NOT NULL THEN NULL ELSE p_size END AS size, s_suppkey IS NOT NULL AS recovered FROM part LEFT JOIN supplier ON p_partkey = s_suppkey * 3")
def left_overlay(spark, d) -> DataFrame:
    """A record with the fields of its recovered version where there is one, be they null or not."""
    fill = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("p_partkey"), "s_name", F.lit(True).alias("has"))
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size").join(fill, "p_partkey", "left")
    return rows.select("p_partkey", F.when(F.col("has"), F.col("s_name")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("has"), F.lit(None)).otherwise(F.col("p_size")).alias("size"), F.coalesce("has", F.lit(False)).alias("recovered"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_resume(spark, d) -> DataFrame:
    """What is left to do: keys without a finished record."""
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT p_partkey AS id, 'synthetic' AS origin, p_name AS name FROM part UNION ALL SELECT s_suppkey * 97, 'real', s_name FROM supplier WHERE s_suppkey * 97 NOT IN (SELECT p_partkey FROM part)")
def catalog_union(spark, d) -> DataFrame:
    """Two catalogues in one; an id of the first hides that of the second."""
    first = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("synthetic").alias("origin"), F.col("p_name").alias("name"))
    second = table(spark, d, "supplier").select((F.col("s_suppkey") * 97).alias("id"), F.lit("real").alias("origin"), F.col("s_name").alias("name"))
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"))


ASSETS_SQL = """WITH a AS (SELECT o_orderkey AS asset_id, ['permission_required', 'owned_generated_content', 'public', 'rights_check_required', 'license_required'][1 + o_orderkey % 5] AS rights,
  CASE WHEN o_custkey % 3 = 0 THEN 'internal' ELSE 'official' END AS source_type, ['question', 'question_answer', 'answer', 'explanation', 'video'][1 + o_custkey % 5] AS kind, 'requested_policy' AS requested FROM orders),
p AS (SELECT *, CASE WHEN rights IN ('permission_required', 'rights_check_required', 'license_required') THEN 'do_not_train_until_permission' WHEN source_type = 'internal' AND rights = 'owned_generated_content' THEN 'train_allowed_after_review' ELSE requested END AS policy FROM a)"""


@query(
    f"""{ASSETS_SQL} SELECT asset_id, policy, CASE WHEN kind IN ('question', 'question_answer') THEN 'problem_parse_and_solve' WHEN kind = 'answer' THEN 'answer_key_alignment' WHEN kind = 'explanation' THEN 'explanation_ingestion_or_generation' ELSE 'asset_review' END AS job_type,
  CASE WHEN policy = 'do_not_train_until_permission' THEN 'blocked' WHEN source_type = 'internal' AND policy = 'train_allowed_after_review' THEN 'queued_generation' ELSE 'queued_rights_review' END AS status FROM p"""
)
def policy_gate(spark, d) -> DataFrame:
    """Training policy and job of each asset from its rights."""
    kinds = [["permission_required", "owned_generated_content", "public", "rights_check_required", "license_required"], ["question", "question_answer", "answer", "explanation", "video"]]
    pick = [F.get(F.array(*[F.lit(k) for k in names]), (F.col(c) % 5).cast("int")) for names, c in zip(kinds, ("o_orderkey", "o_custkey"), strict=True)]
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), pick[0].alias("rights"), F.when(F.col("o_custkey") % 3 == 0, "internal").otherwise("official").alias("source_type"), pick[1].alias("kind"), F.lit("requested_policy").alias("requested"))
    return policy(rows).select("asset_id", "policy", "job_type", "status")


@query("SELECT name, n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")) + ")")
def table_counts(spark, d) -> DataFrame:
    """Rows of each table, from the files' footers."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
    parts = [table(spark, d, t).groupBy().agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def status_counts(spark, d) -> DataFrame:
    """Counts by status, by status and priority, and in all."""
    return table(spark, d, "orders").rollup(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, coalesce(sum((props->>'$.k')::BIGINT), 0)::BIGINT AS total, count(DISTINCT (props->>'$.k')::BIGINT) AS kinds FROM events GROUP BY event_type")
def json_field_stats(spark, d) -> DataFrame:
    """Sums over a field of JSON properties."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("total"), F.countDistinct(k).alias("kinds"))


@query("SELECT coalesce(sum(json_array_length('[' || array_to_string(string_split(p_name, ' '), ',') || ']')), 0)::BIGINT AS total FROM (SELECT p_partkey, regexp_replace(p_name, '[a-z]+', '1', 'g') AS p_name FROM part)")
def json_array_lengths(spark, d) -> DataFrame:
    ones = F.regexp_replace("p_name", "[a-z]+", "1")
    text = F.concat(F.lit("["), F.array_join(F.split(ones, " "), ","), F.lit("]"))
    return table(spark, d, "part").agg(F.coalesce(F.sum(F.json_array_length(text)), F.lit(0)).alias("total"))


@query("WITH p AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS header FROM events), g AS (SELECT *, count(header) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM p) SELECT user_id, event_id, max(header) OVER (PARTITION BY user_id, c) AS subject FROM g")
def carry_forward(spark, d) -> DataFrame:
    """The last header seen, on each page after it."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("header"))
    return rows.select("user_id", "event_id", F.last("header", ignorenulls=True).over(w).alias("subject"))


@query("SELECT user_id, event_id AS start, lead(event_id, 1, 1000000) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM events")
def boundary_spans(spark, d) -> DataFrame:
    """Spans from one boundary to the next."""
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("start"), F.lead("event_id", 1, 1000000).over(w).alias("stop"))


@query("SELECT o_custkey AS user_id, string_agg(DISTINCT extract(year FROM o_orderdate)::VARCHAR, ',' ORDER BY extract(year FROM o_orderdate)::VARCHAR) AS years, count(*) AS n FROM orders GROUP BY o_custkey")
def practice_years(spark, d) -> DataFrame:
    """The distinct years of a user's sets, ascending."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("years"), F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(route, 'default') AS backend FROM customer LEFT JOIN (VALUES ('BUILDING', 'codex'), ('MACHINERY', 'local')) r(segment, route) ON c_mktsegment = segment")
def route_backend(spark, d) -> DataFrame:
    """The backend of each subject; others go to the default."""
    routes = F.str_to_map(F.lit("BUILDING:codex,MACHINERY:local"), F.lit(","), F.lit(":"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.try_element_at(routes, F.col("c_mktsegment")), F.lit("default")).alias("backend"))


@query("SELECT s_suppkey, 'S-' || lpad((row_number() OVER (ORDER BY s_suppkey) + (SELECT max(try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS INT)) FROM customer))::VARCHAR, 9, '0') AS new_id FROM supplier")
def next_ids(spark, d) -> DataFrame:
    """Ids that go on from the largest number in use."""
    known = table(spark, d, "customer").select(F.col("c_name").alias("new_id"))
    return sinks.next_ids(known, table(spark, d, "supplier").select("s_suppkey"), "new_id", "S-", "s_suppkey", 9)


@query("SELECT s_suppkey, '{\"s_name\": \"' || s_name || '\", \"s_nationkey\": \"' || s_nationkey || '\", \"s_suppkey\": \"' || s_suppkey || '\"}' AS line FROM supplier")
def canonical_lines(spark, d) -> DataFrame:
    """Rows as JSON lines with sorted keys."""
    return table(spark, d, "supplier").select("s_suppkey", sinks.canonical_json(["s_suppkey", "s_name", "s_nationkey"]).alias("line"))
