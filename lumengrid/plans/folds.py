"""Queries of the sequential operators and of the remaining joins over small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.operators import folds
from lumengrid.plans.registry import query
from lumengrid.sources.tables import table


@query(
    """WITH RECURSIVE m AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS i, l_returnflag = 'R' AS sell,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE l_quantity END::DOUBLE AS qty, (l_extendedprice / l_quantity)::DOUBLE AS price FROM lineitem),
s AS (SELECT DISTINCT l_partkey, 0::BIGINT AS i, 0::DOUBLE AS units, 0::DOUBLE AS value, 0::DOUBLE AS sold FROM lineitem
  UNION ALL SELECT s.l_partkey, m.i, CASE WHEN sell AND qty > units THEN NULL WHEN sell THEN units - qty ELSE units + qty END,
  CASE WHEN sell AND qty > units THEN NULL WHEN sell THEN value - value / units * qty ELSE value + qty * price END, CASE WHEN sell AND qty > units THEN NULL WHEN sell THEN sold + value / units * qty ELSE sold END
  FROM s JOIN m ON m.l_partkey = s.l_partkey AND m.i = s.i + 1)
SELECT l_partkey, arg_max(struct_pack(u := units), i).u AS units, round(arg_max(struct_pack(u := value), i).u, 2) AS value, round(arg_max(struct_pack(u := sold), i).u, 2) AS sold FROM s GROUP BY l_partkey"""
)
def moving_average_inventory(spark, d) -> DataFrame:
    """Moving-average stock of each part over its lines in order: returns are sales."""
    sell = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").withColumns({"sell": sell, "qty": F.when(sell, 1.0).otherwise(F.col("l_quantity")).cast("double"), "price": (F.col("l_extendedprice") / F.col("l_quantity")).cast("double")})
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    kind = dict(rows.dtypes)["l_partkey"]
    out = folds.streamed(rows, "l_partkey", order, ["sell", "qty", "price"], f"l_partkey {kind}, units double, value double, sold double", lambda: (0.0, 0.0, 0.0), folds.moving_average_step, lambda k, s: (k, *(s or (None, None, None))))
    return out.select("l_partkey", "units", F.round("value", 2).alias("value"), F.round("sold", 2).alias("sold"))


@query("SELECT o_orderkey, round(o_totalprice + o_custkey * 2 - 300, 2) AS total, NULL::DOUBLE AS unknown FROM orders")
def cash_flow_statement(spark, d) -> DataFrame:
    """A total with signed items; an item of unknown kind makes it null."""
    items = [("depreciation", F.col("o_custkey") * 2.0), ("rise of receivables", F.lit(300.0))]
    array = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("amount")) for k, v in items])
    odd = F.array(F.struct(F.lit("mystery").alias("label"), F.lit(1.0).alias("amount")))
    signs = {"depreciation": 1, "rise of": -1}
    return table(spark, d, "orders").select("o_orderkey", F.round(folds.signed_total(F.col("o_totalprice"), array, signs), 2).alias("total"), folds.signed_total(F.col("o_totalprice"), odd, signs).alias("unknown"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, (event_id * 7) % 11 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 1::BIGINT AS next, []::BIGINT[] AS kept FROM events
  UNION ALL SELECT s.user_id, e.i, CASE WHEN n BETWEEN next AND next + 3 THEN n + 1 ELSE next END, CASE WHEN n BETWEEN next AND next + 3 THEN list_append(kept, n) ELSE kept END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, len(arg_max(kept, i)) AS n, array_to_string(arg_max(kept, i), ',') AS kept FROM s GROUP BY user_id"""
)
def sequential_numbering(spark, d) -> DataFrame:
    """Numbers that continue a numbering, per user and in log order."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.pmod(F.col("event_id") * 7, F.lit(11)).cast("long").alias("n"))
    kind = dict(rows.dtypes)["user_id"]
    return folds.streamed(rows, "user_id", ["event_id"], ["n"], f"user_id {kind}, n long, kept string", lambda: (1, []), folds.accepted_step, lambda k, s: (k, len(s[1]), ",".join(map(str, s[1]))))


@query(
    """WITH r AS (SELECT o_orderkey, unnest([0.02::DOUBLE, 0.05, 0.08, 0.12]) AS r, unnest(range(4)) AS i, o_totalprice AS p, 0.3 + (o_custkey % 20) / 100 AS k FROM orders),
v AS (SELECT o_orderkey, i, abs(-p + p * k / (1 + r) + p * k / (1 + r)^2 + p * k / (1 + r)^3) AS d FROM r) SELECT o_orderkey, arg_min(i, (d, i))::INT AS choice FROM v GROUP BY o_orderkey"""
)
def irr_closest_rate(spark, d) -> DataFrame:
    p, k = F.col("o_totalprice"), 0.3 + (F.col("o_custkey") % 20) / 100
    return table(spark, d, "orders").select("o_orderkey", folds.closest_rate(p, F.array(p * k, p * k, p * k), F.array(*[F.lit(x) for x in (0.02, 0.05, 0.08, 0.12)])).alias("choice"))


@query(
    """WITH x AS (SELECT o_orderkey, (o_custkey * 20000)::DOUBLE AS i, (o_orderkey % 7 * 1000000)::DOUBLE AS f, o_totalprice * 100 AS e FROM orders)
SELECT o_orderkey, round(i + f + e + CASE WHEN i + f + e > 2e7 THEN greatest(0.0, e - greatest(0.0, 2e7 - (i + f))) ELSE 0.0 END * 0.1)::BIGINT AS income, round(e * 0.04 + e * (0.04::DOUBLE - 0.02::DOUBLE) * 0.2 + e * 0.02 * 0.1)::BIGINT AS acquisition FROM x"""
)
def grossup_and_surtaxes(spark, d) -> DataFrame:
    eligible = F.col("o_totalprice") * 100
    income = folds.income_with_grossup(F.col("o_custkey") * 20000.0, F.col("o_orderkey") % 7 * 1000000.0, eligible)
    return table(spark, d, "orders").select("o_orderkey", F.round(income).cast("long").alias("income"), F.round(folds.acquisition_with_surtaxes(eligible, F.lit(0.04))).cast("long").alias("acquisition"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 2 = 1 THEN false ELSE len(list_filter(string_split_regex('small thing, ' || p_type, '[\\s,·]+'), lambda x: length(x) >= 4 AND contains(upper(p_name), upper(x)))) > 0 END AS hit FROM part"""
)
def attractor_hit(spark, d) -> DataFrame:
    """Whether a wrong choice holds a part of a trap: null without traps, false for a right answer."""
    traps = F.when(F.col("p_size") % 4 != 0, F.array(F.concat(F.lit("SMALL THING, "), F.upper("p_type"))))
    return table(spark, d, "part").select("p_partkey", folds.trap_hit(traps, F.upper("p_name"), F.col("p_size") % 2 == 1).alias("hit"))


@query(
    """WITH s AS (SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_name), '[^0-9a-z가-힣]', '', 'g') AS s FROM part)
SELECT p_partkey, (CASE WHEN contains(s, 'redwidget') THEN 16 ELSE 5 * (contains(s, 'red')::INT + contains(s, 'widget')::INT) END + CASE WHEN contains(s, 'bolt') THEN 16 ELSE 0 END)::INT AS score FROM s"""
)
def loose_concept_score(spark, d) -> DataFrame:
    source = folds.search_key(F.concat_ws(" ", "p_brand", "p_name"))
    return table(spark, d, "part").select("p_partkey", folds.loose_match(source, F.array(F.lit("Red: widget"), F.lit("BOLT"), F.lit("!"))).alias("score"))


@query("SELECT c_custkey, CASE WHEN h > 0 THEN round(round(h / 5, 2) + CASE WHEN abs(round(h - round(h / 5, 2) * 5, 2)) >= 0.01 THEN round(h - round(h / 5, 2) * 5, 2) ELSE 0.0 END, 2) ELSE 0.0 END AS first, CASE WHEN h > 0 THEN round(h / 5, 2) ELSE 0.0 END AS other FROM (SELECT c_custkey, (c_custkey % 30) * 1.37::DOUBLE AS h FROM customer)")
def fallback_plan(spark, d) -> DataFrame:
    """One week in equal parts for a learner without state."""
    parts = folds.equal_split((F.col("c_custkey") % 30) * 1.37, 5)
    return table(spark, d, "customer").select("c_custkey", parts[0].alias("first"), parts[1].alias("other"))


@query("SELECT c_custkey, least(greatest(floor(h * 60 * 0.32 + 0.5), 45), 120)::BIGINT AS solve_minutes, least(greatest(floor(h * 60 * 0.14 + 0.5), 15), 60)::BIGINT AS review_minutes FROM (SELECT c_custkey, (c_custkey % 9)::DOUBLE AS h FROM customer)")
def daily_budget(spark, d) -> DataFrame:
    """Minutes a day, clamped; halves go up."""
    h = (F.col("c_custkey") % 9).cast("double")

    def clamp(share: float, low: int, high: int):
        return F.least(F.greatest(F.floor(h * 60 * share + 0.5), F.lit(low)), F.lit(high)).cast("long")

    return table(spark, d, "customer").select("c_custkey", clamp(0.32, 45, 120).alias("solve_minutes"), clamp(0.14, 15, 60).alias("review_minutes"))


@query(
    """WITH e AS (SELECT event_id, ['rag_chunk', 'problem', 'tutorial'][1 + event_id % 3] AS kind, user_id AS ref FROM events)
SELECT event_id, kind, coalesce(p_name, s_name, c_name) AS name FROM e LEFT JOIN part ON kind = 'rag_chunk' AND ref = p_partkey LEFT JOIN supplier ON kind = 'problem' AND ref = s_suppkey LEFT JOIN customer ON kind = 'tutorial' AND ref = c_custkey
WHERE coalesce(p_name, s_name, c_name) IS NOT NULL"""
)
def edge_targets(spark, d) -> DataFrame:
    """Edges to chunks, problems and tutorials with their names; dangling ones go."""
    kinds = F.array(*[F.lit(k) for k in ("rag_chunk", "problem", "tutorial")])
    edges = table(spark, d, "events").select("event_id", F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("kind"), F.col("user_id").alias("ref"))
    targets = [(t, k, n) for t, k, n in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))]
    names = None
    for (t, k, n), kind in zip(targets, ("rag_chunk", "problem", "tutorial"), strict=True):
        rows = table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(k).alias("ref"), F.col(n).alias("name"))
        names = rows if names is None else names.unionByName(rows)
    return edges.join(names, ["kind", "ref"]).select("event_id", "kind", "name")
