"""Robots rules over pages, a tree of parts, generation plans and the counts of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.operators import generation, hierarchy, robots
from lumengrid.plans.registry import query
from lumengrid.sources.folders import shared_folder
from lumengrid.sources.tables import table

# Recorded rules: each page is a rule of its host, for its first one to three steps; every third host has rules for ``bot``.
URL_SQL = """u AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS p FROM pages),
v AS (SELECT page_id, host, CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS path FROM u)"""
STEPS = "(/[^/?]*){0,%d}"


@query(
    f"""WITH {URL_SQL},
r AS (SELECT host, CASE WHEN length(host) % 3 = 0 AND page_id % 2 = 0 THEN 'bot' ELSE '*' END AS agent, page_id % 5 > 1 AS allow,
  CASE page_id % 3 WHEN 0 THEN regexp_extract(path, '^(/[^/?]*){{0,1}}') WHEN 1 THEN regexp_extract(path, '^(/[^/?]*){{0,2}}') ELSE regexp_extract(path, '^(/[^/?]*){{0,3}}') END AS prefix FROM v),
own AS (SELECT DISTINCT host FROM r WHERE agent = 'bot'),
s AS (SELECT host, prefix, bool_or(allow) AS allow FROM r WHERE prefix <> '' AND (agent = 'bot' OR host NOT IN (SELECT host FROM own)) GROUP BY host, prefix),
m AS (SELECT page_id, arg_max(allow, length(prefix)) AS allow, arg_max(prefix, length(prefix)) AS rule FROM v JOIN s ON v.host = s.host AND starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, v.host, path, coalesce(allow, true) AS allowed, rule FROM v LEFT JOIN m USING (page_id)"""
)
def robots_gate(spark, d) -> DataFrame:
    """Whether recorded rules let a page be fetched: the longest prefix of its path decides."""
    pages = table(spark, d, "pages")
    host, path = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    rows = pages.select("page_id", host.alias("host"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"))
    prefix = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("path", "^" + STEPS % 1, 0)).when(F.col("page_id") % 3 == 1, F.regexp_extract("path", "^" + STEPS % 2, 0)).otherwise(F.regexp_extract("path", "^" + STEPS % 3, 0))
    agent = F.when((F.length("host") % 3 == 0) & (F.col("page_id") % 2 == 0), "bot").otherwise("*")
    rules = rows.select("host", agent.alias("agent"), (F.col("page_id") % 5 > 1).alias("allow"), prefix.alias("prefix"))
    return robots.gated(pages.select(F.col("page_id").alias("url_id"), "url"), rules, "bot").withColumnRenamed("url_id", "page_id")


@query(
    """WITH RECURSIVE t AS (SELECT p_partkey AS node, nullif(p_partkey // 3, 0) AS parent, coalesce(n, 0) AS value FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_partkey = p_partkey),
up AS (SELECT node, node AS above, 0 AS steps FROM t UNION ALL SELECT up.node, parent, steps + 1 FROM up JOIN t ON t.node = above WHERE parent IN (SELECT node FROM t)),
depths AS (SELECT node, max(steps) AS depth FROM up GROUP BY node),
sums AS (SELECT above AS node, count(*) AS n_below, sum(value)::BIGINT AS total FROM up JOIN t USING (node) GROUP BY above)
SELECT node, parent, depth::BIGINT AS depth, n_below, total FROM t JOIN depths USING (node) JOIN sums USING (node)"""
)
def node_rollup(spark, d) -> DataFrame:
    """Attempts of each node of a tree of parts, with those of all nodes below it."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("value"))
    up = F.nullif(F.floor(F.col("p_partkey") / 3), F.lit(0))
    return hierarchy.rolled_up(table(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("node"), up.alias("parent"), "value"))


@query(
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN ' , ' ELSE p_type || ':' || CASE WHEN p_partkey % 9 = 1 THEN ' ' ELSE p_brand END || ': ' || ['easy', 'mid', 'hard', 'odd'][p_size % 4 + 1] || [':' || p_size, ':0', ':x', '', ':1:2'][p_partkey % 5 + 1] || ', ' || p_name || ' ,' END AS spec FROM part),
i AS (SELECT p_partkey, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS item FROM (SELECT p_partkey, list_filter(list_transform(string_split(spec, ','), lambda e: trim(e)), lambda e: e <> '') AS l FROM s)),
f AS (SELECT *, list_transform(string_split(item, ':'), lambda p: trim(p)) AS p FROM i),
e AS (SELECT p_partkey, n, item, p[1] AS subject, p[2] AS unit, p[3] AS difficulty, CASE WHEN len(p) = 3 THEN 1 ELSE try_cast(p[4] AS BIGINT) END AS c,
  CASE WHEN len(p) NOT IN (3, 4) THEN 'format' WHEN p[1] NOT IN (SELECT DISTINCT p_type FROM part WHERE p_size < 40) THEN 'subject' WHEN p[2] = '' THEN 'unit' WHEN p[3] NOT IN ('easy', 'mid', 'hard') THEN 'difficulty'
    WHEN len(p) = 4 AND try_cast(p[4] AS BIGINT) IS NULL THEN 'count' WHEN len(p) = 4 AND try_cast(p[4] AS BIGINT) < 1 THEN 'count_below_one' END AS error FROM f)
SELECT p_partkey, n, item, subject, unit, difficulty, CASE WHEN error IS NULL THEN c END AS count, error FROM e
UNION ALL SELECT p_partkey, 0, '', NULL, NULL, NULL, NULL, 'empty' FROM s WHERE p_partkey NOT IN (SELECT p_partkey FROM i)"""
)
def item_specs(spark, d) -> DataFrame:
    """Generation plans subject:unit:difficulty[:count], written from parts, with what is wrong with each item."""
    part = table(spark, d, "part")
    subjects = sorted(r["p_type"] for r in part.where("p_size < 40").select("p_type").distinct().collect())  # a short list of types
    key = F.col("p_partkey")
    hard = F.element_at(F.array(*map(F.lit, ("easy", "mid", "hard", "odd"))), (F.col("p_size") % 4 + 1).cast("int"))
    tail = F.when(key % 5 == 0, F.concat(F.lit(":"), F.col("p_size").cast("string"))).when(key % 5 == 1, ":0").when(key % 5 == 2, ":x").when(key % 5 == 3, "").otherwise(":1:2")
    spec = F.when(key % 9 == 0, " , ").otherwise(F.concat("p_type", F.lit(":"), F.when(key % 9 == 1, " ").otherwise(F.col("p_brand")), F.lit(": "), hard, tail, F.lit(", "), "p_name", F.lit(" ,")))
    rows = part.select("p_partkey", F.posexplode(generation.items_of(spec, subjects)).alias("n", "i"))
    return rows.select("p_partkey", F.col("n").cast("long").alias("n"), "i.*")


@query(
    """SELECT count(*) FILTER (l_returnflag <> 'A') AS written, count(*) FILTER (l_returnflag = 'A') AS rejected, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS flagged,
  count(*) FILTER (l_returnflag = 'R') AS revised, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS batch_failed FROM lineitem"""
)
def generation_counts(spark, d) -> DataFrame:
    """Counts of a run, taken while its questions are written: an order is a batch, a line a question."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flag = F.col("l_returnflag")
    counts = {"written": flag != "A", "rejected": flag == "A", "flagged": (flag == "N") & (F.col("l_linestatus") == "F"), "revised": flag == "R", "batch_failed": F.col("l_orderkey").isNull()}
    found = generation.written_with_counts(rows, f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}", flag != "A", counts)
    return spark.createDataFrame([tuple(found[c] for c in counts)], ", ".join(f"{c} long" for c in counts))


LADDER = [("PROMO", ("Brand#11", "Brand#12"), "t_promo_cost"), ("PROMO", (), "t_promo"), ("STANDARD", (), "t_standard"), ("ECONOMY", ("Brand#13",), "t_economy_vat")]


@query(
    """SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) = 'PROMO' AND p_brand IN ('Brand#11', 'Brand#12') THEN 't_promo_cost' WHEN split_part(p_type, ' ', 1) = 'PROMO' THEN 't_promo' WHEN split_part(p_type, ' ', 1) = 'STANDARD' THEN 't_standard'
  WHEN split_part(p_type, ' ', 1) = 'ECONOMY' AND p_brand = 'Brand#13' THEN 't_economy_vat' ELSE '' END AS tutorial FROM part"""
)
def tutorial_ids(spark, d) -> DataFrame:
    """The tutorial of each problem, by subject and unit."""
    return table(spark, d, "part").select("p_partkey", generation.tutorial_of(F.split_part("p_type", F.lit(" "), F.lit(1)), F.col("p_brand"), LADDER).alias("tutorial"))
