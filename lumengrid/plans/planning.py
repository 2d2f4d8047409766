"""Study plan queries: a plan is a customer; its days and hours follow from the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.operators import planning
from lumengrid.plans.registry import ORACLE_SQL, query
from lumengrid.sources.tables import table

STAGE_NAMES = [s for s, _ in planning.STAGES]
PLANS_SQL = f"plans AS (SELECT c_custkey AS plan_id, (c_custkey * 7 % 400)::INT AS days, {STAGE_NAMES}[1 + c_custkey % 6] AS stage, round((c_custkey % 9) * 0.75::DOUBLE, 2) AS hours_per_day FROM customer)"
STATES_SQL = f"{PLANS_SQL}, states AS (SELECT plan_id, r_name AS subject, r_regionkey AS position, ((plan_id * 13 + r_regionkey * 29) % 100) / 100 AS accuracy, hours_per_day FROM plans, region)"


def _plans(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("plan_id"), (key * 7 % 400).cast("int").alias("days"), F.get(F.array(*[F.lit(s) for s in STAGE_NAMES]), (key % 6).cast("int")).alias("stage"), F.round((key % 9) * 0.75, 2).alias("hours_per_day")
    )


def _states(spark, d) -> DataFrame:
    subjects = table(spark, d, "region").agg(F.collect_list(F.struct("r_regionkey", "r_name")).alias("s"))  # five rows, a fixed dimension
    rows = _plans(spark, d).join(F.broadcast(subjects), F.lit(True)).select("plan_id", "hours_per_day", F.inline("s"))
    accuracy = ((F.col("plan_id") * 13 + F.col("r_regionkey") * 29) % 100) / 100
    return rows.select("plan_id", F.col("r_name").alias("subject"), F.col("r_regionkey").alias("position"), accuracy.alias("accuracy"), "hours_per_day")


WEEKS = "greatest(1, least(52, ceil(greatest(days, 0) / 7)::INT))"


@query(f"WITH {PLANS_SQL}, w AS (SELECT plan_id, days, unnest(range(1, {WEEKS} + 1)) AS week FROM plans) SELECT plan_id, week, 'D-' || greatest(days - (week - 1) * 7, 0) || '~D-' || greatest(greatest(days - (week - 1) * 7, 0) - 6, 0) AS label FROM w")
def week_generator(spark, d) -> DataFrame:
    return planning.weeks(_plans(spark, d))


@query(
    f"""WITH {PLANS_SQL}, st AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}', {w})" for i, (s, w) in enumerate(planning.STAGES))}) AS v(i, stage, w)),
l AS (SELECT plan_id, {WEEKS} AS t, st.* FROM plans JOIN st ON st.i >= (SELECT i FROM st s2 WHERE s2.stage = plans.stage)),
a AS (SELECT *, count(*) OVER p AS n, sum(w) OVER p AS total FROM l WINDOW p AS (PARTITION BY plan_id)), b AS (SELECT *, greatest(t - n, 0) AS extra FROM a),
c AS (SELECT *, (extra * w) // total AS fl, (extra * w) % total AS rest FROM b), e AS (SELECT *, extra - sum(fl) OVER (PARTITION BY plan_id) AS missing, row_number() OVER (PARTITION BY plan_id ORDER BY rest DESC, i DESC) AS rk, row_number() OVER (PARTITION BY plan_id ORDER BY i DESC) AS last FROM c),
f AS (SELECT plan_id, stage, CASE WHEN t <= n THEN (last <= t)::INT ELSE 1 + fl + (rk <= missing)::INT END::BIGINT AS n_weeks FROM e) SELECT * FROM f WHERE n_weeks > 0"""
)
def stage_apportion(spark, d) -> DataFrame:
    return planning.stage_weeks(_plans(spark, d))


@query(
    f"""WITH {STATES_SQL}, a AS (SELECT *, round(7 * hours_per_day, 2) AS h_all, count(*) OVER (PARTITION BY plan_id) AS n, CASE WHEN accuracy >= 0.70 THEN 0.0 ELSE 1 - accuracy + CASE WHEN accuracy < 0.40 THEN 0.5 ELSE 0.0 END END::DOUBLE AS w FROM states),
b AS (SELECT *, CASE WHEN h_all - n * (0.05::DOUBLE * h_all) < 0 THEN h_all / n ELSE 0.05::DOUBLE * h_all END AS m, sum(w) OVER (PARTITION BY plan_id) AS w_all FROM a),
c AS (SELECT *, CASE WHEN h_all - n * (0.05::DOUBLE * h_all) < 0 THEN 0.0 ELSE h_all - n * m END AS pool FROM b),
e AS (SELECT *, m + CASE WHEN w_all > 0 THEN pool * w / w_all ELSE pool / n END AS h FROM c),
f AS (SELECT *, CASE WHEN accuracy < 0.40 AND h < 0.15::DOUBLE * h_all THEN 0.15::DOUBLE * h_all - h ELSE 0.0 END AS raise, CASE WHEN accuracy < 0.40 THEN 0.0 ELSE greatest(h - m, 0.0) END AS spare FROM e),
g AS (SELECT *, sum(raise) OVER (PARTITION BY plan_id) AS raised, sum(spare) OVER (PARTITION BY plan_id) AS room FROM f),
i AS (SELECT *, round(h + raise - spare * CASE WHEN room > 0 THEN least(1.0, raised / room) ELSE 0.0 END, 2) AS r FROM g),
j AS (SELECT *, round(h_all - sum(r) OVER (PARTITION BY plan_id), 2) AS drift, row_number() OVER (PARTITION BY plan_id ORDER BY r DESC, position) = 1 AS largest FROM i)
SELECT plan_id, subject, CASE WHEN h_all <= 0 THEN 0.0 ELSE round(r + CASE WHEN largest AND abs(drift) >= 0.01 THEN drift ELSE 0.0 END, 2) END AS hours FROM j"""
)
def hours_allocation(spark, d) -> DataFrame:
    return planning.subject_hours(_states(spark, d))


@query("WITH r AS (SELECT p_type, p_partkey, floor((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) / greatest(ceil(count(*) OVER (PARTITION BY p_type) / 12), 1))::BIGINT AS slot FROM part) SELECT * FROM r")
def content_slots(spark, d) -> DataFrame:
    """Items dealt evenly over twelve teaching weeks."""
    return planning.slots(table(spark, d, "part").select("p_type", "p_partkey"), ["p_type"], ["p_partkey"], F.lit(12))


@query("SELECT o_custkey, o_orderkey, [2021, 2022, 2023][1 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 3]::INT AS year FROM orders")
def content_rotation(spark, d) -> DataFrame:
    """Years in turn over a user's rotation weeks."""
    weeks = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return planning.rotation(weeks, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.array(F.lit(2021), F.lit(2022), F.lit(2023))).select("o_custkey", "o_orderkey", "year")


@query(f"WITH {PLANS_SQL}, x AS (SELECT plan_id, round(3500 * (plan_id % 7) / 6)::BIGINT AS required, round(hours_per_day * days, 2) AS planned FROM plans) SELECT *, CASE WHEN required <= 0 OR planned / required >= 1.0 THEN 'feasible' WHEN planned / required >= 0.70 THEN 'tight' ELSE 'infeasible' END AS verdict FROM x")
def feasibility(spark, d) -> DataFrame:
    rows = _plans(spark, d).select("plan_id", F.round(3500 * (F.col("plan_id") % 7) / 6).cast("long").alias("required"), F.round(F.col("hours_per_day") * F.col("days"), 2).alias("planned"))
    return rows.withColumn("verdict", planning.feasibility(F.col("required"), F.col("planned")))


def _cte(name: str, sql: str) -> str:
    """A query's SQL as a common table of another one."""
    return f"{name} AS ({sql})"


_ORDER_SQL = "CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for i, (s, _) in enumerate(planning.STAGES)) + " END"


@query(
    f"""WITH {_cte('wk', ORACLE_SQL['week_generator'])}, {_cte('ap', ORACLE_SQL['stage_apportion'])}, {_cte('ha', ORACLE_SQL['hours_allocation'])},
sp AS (SELECT *, sum(n_weeks) OVER (PARTITION BY plan_id ORDER BY {_ORDER_SQL}) AS last FROM ap), ea AS (SELECT plan_id, stage, unnest(range((last - n_weeks + 1)::BIGINT, last::BIGINT + 1)) AS week FROM sp),
ho AS (SELECT plan_id, string_agg(subject || '=' || hours::DECIMAL(10,2), ',' ORDER BY r_regionkey) AS hours FROM ha JOIN region ON r_name = subject GROUP BY plan_id)
SELECT plan_id, week, label, stage, hours FROM wk LEFT JOIN ea USING (plan_id, week) LEFT JOIN ho USING (plan_id)"""
)
def full_plan(spark, d) -> DataFrame:
    """Every week of a plan with its label, its stage and the hours of each subject."""
    return planning.full_plan(_plans(spark, d), _states(spark, d))
