"""Study plans: weeks, stages by largest remainder, hours for subjects, content by rotation, feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Stages in their order with their weights.
STAGES = [("intro", 1), ("post_lecture", 2), ("objective_entry", 3), ("past_exam_rotation", 4), ("mock_exam", 2), ("final", 1)]
FULL_HOURS = 3500


def total_weeks(days: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.greatest(days, F.lit(0)) / 7).cast("int")))


def weeks(plans: DataFrame, most: int = 52) -> DataFrame:
    """plan_id, week, label: one row a week, with its days to the exam, clipped at 0. plans: plan_id, days."""
    rows = plans.select("plan_id", "days", F.explode(F.sequence(F.lit(1), total_weeks(F.col("days"), most))).alias("week"))
    first = F.greatest(F.col("days") - (F.col("week") - 1) * 7, F.lit(0))
    last = F.greatest(first - 6, F.lit(0))
    return rows.select("plan_id", F.col("week").cast("long").alias("week"), F.concat(F.lit("D-"), first.cast("string"), F.lit("~D-"), last.cast("string")).alias("label"))


def stage_weeks(plans: DataFrame, most: int = 52) -> DataFrame:
    """plan_id, stage, n_weeks: from the current stage on, one week each and the rest by weight and largest remainder (ties
    to the later stage); with fewer weeks than stages, the last stages get one each. plans: plan_id, days, stage."""
    stages = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage"), F.lit(w).alias("w")) for i, (s, w) in enumerate(STAGES)])
    names = F.array(*[F.lit(s) for s, _ in STAGES])
    current = F.greatest(F.array_position(names, F.col("stage")) - 1, F.lit(0))
    rows = plans.select("plan_id", total_weeks(F.col("days"), most).alias("t"), F.filter(stages, lambda s: s["i"] >= current).alias("left"))
    rows = rows.select("plan_id", "t", F.size("left").alias("n"), F.aggregate("left", F.lit(0), lambda a, s: a + s["w"]).alias("all"), F.explode("left").alias("s")).select("plan_id", "t", "n", "all", "s.*")
    extra = F.greatest(F.col("t") - F.col("n"), F.lit(0))
    numerator = extra * F.col("w")
    rows = rows.withColumns({"floor": F.floor(numerator / F.col("all")), "rest": numerator % F.col("all"), "extra": extra})
    by = W.partitionBy("plan_id")
    rows = rows.withColumn("missing", F.col("extra") - F.sum("floor").over(by))
    rank = F.row_number().over(by.orderBy(F.desc("rest"), F.desc("i")))
    rows = rows.withColumns({"rank": rank, "from_last": F.row_number().over(by.orderBy(F.desc("i")))})
    count = F.when(F.col("t") <= F.col("n"), (F.col("from_last") <= F.col("t")).cast("int")).otherwise(1 + F.col("floor") + (F.col("rank") <= F.col("missing")).cast("int"))
    return rows.select("plan_id", "stage", count.cast("long").alias("n_weeks")).where("n_weeks > 0")


def subject_hours(states: DataFrame) -> DataFrame:
    """plan_id, subject, hours: 5 % of the week each for upkeep, the rest by weakness; a failing subject (accuracy under
    0.40) gets 15 % at least, taken from the others in proportion; what rounding leaves goes to the largest. Sums over a
    plan's subjects are taken by position, so a value at the middle of two hundredths falls alike in whatever order rows come.

    states: plan_id, subject, position, accuracy, hours_per_day.
    """
    plan = W.partitionBy("plan_id")
    by = plan.orderBy("position", "subject").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.round(7 * F.col("hours_per_day"), 2)
    rows = states.withColumns({"h_all": total, "n": F.count("*").over(by)})
    weight = F.when(F.col("accuracy") >= 0.70, 0.0).otherwise(1 - F.col("accuracy") + F.when(F.col("accuracy") < 0.40, 0.5).otherwise(0.0))
    upkeep = 0.05 * F.col("h_all")
    short = F.col("h_all") - F.col("n") * upkeep < 0
    rows = rows.withColumns({"w": weight, "m": F.when(short, F.col("h_all") / F.col("n")).otherwise(upkeep)})
    rows = rows.withColumns({"pool": F.when(short, 0.0).otherwise(F.col("h_all") - F.col("n") * F.col("m")), "w_all": F.sum("w").over(by)})
    rows = rows.withColumn("h", F.col("m") + F.when(F.col("w_all") > 0, F.col("pool") * F.col("w") / F.col("w_all")).otherwise(F.col("pool") / F.col("n")))
    floor = 0.15 * F.col("h_all")
    raised = F.when((F.col("accuracy") < 0.40) & (F.col("h") < floor), floor - F.col("h")).otherwise(0.0)
    spare = F.when((F.col("accuracy") < 0.40), 0.0).otherwise(F.greatest(F.col("h") - F.col("m"), F.lit(0.0)))
    rows = rows.withColumns({"raise": raised, "spare": spare})
    rows = rows.withColumns({"raised": F.sum("raise").over(by), "room": F.sum("spare").over(by)})
    cut = F.col("spare") * F.when(F.col("room") > 0, F.least(F.lit(1.0), F.col("raised") / F.col("room"))).otherwise(0.0)
    rows = rows.withColumn("r", F.round(F.col("h") + F.col("raise") - cut, 2))
    drift = F.round(F.col("h_all") - F.sum("r").over(by), 2)
    rows = rows.withColumns({"drift": drift, "largest": F.row_number().over(plan.orderBy(F.desc("r"), "position")) == 1})
    hours = F.round(F.col("r") + F.when(F.col("largest") & (F.abs("drift") >= 0.01), F.col("drift")).otherwise(0.0), 2)
    return rows.select("plan_id", "subject", F.when(F.col("h_all") <= 0, 0.0).otherwise(hours).alias("hours"))


def full_plan(plans: DataFrame, states: DataFrame, most: int = 52) -> DataFrame:
    """plan_id, week, label, stage, hours (text of subject=hours by position): every week of a plan, with its stage (stages
    take their weeks one after the other) and the hours of each subject. plans: plan_id, days, stage. states as for
    ``subject_hours``."""
    names = F.array(*[F.lit(s) for s, _ in STAGES])
    order = W.partitionBy("plan_id").orderBy(F.array_position(names, F.col("stage")))
    spans = stage_weeks(plans, most).withColumn("last", F.sum("n_weeks").over(order))
    each = spans.select("plan_id", "stage", F.explode(F.sequence(F.col("last") - F.col("n_weeks") + 1, F.col("last"))).alias("week"))
    said = F.concat("subject", F.lit("="), F.col("hours").cast("decimal(10,2)").cast("string"))
    given = subject_hours(states).join(states.select("plan_id", "subject", "position"), ["plan_id", "subject"])
    hours = given.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", said.alias("s")))), lambda x: x["s"]), ",").alias("hours"))
    return weeks(plans, most).join(each, ["plan_id", "week"], "left").join(hours, "plan_id", "left").select("plan_id", "week", "label", "stage", "hours")


def slots(items: DataFrame, by: list[str], order: list[str], n_slots: Column) -> DataFrame:
    """Adds slot (from 0): items in order, dealt evenly, ceil(items / slots) to each slot."""
    w = W.partitionBy(*by)
    each = F.greatest(F.ceil(F.count("*").over(w) / n_slots), F.lit(1))
    return items.withColumn("slot", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / each).cast("long"))


def rotation(weeks_of: DataFrame, by: list[str], order: list[str], years: Column) -> DataFrame:
    """Adds year: the k-th week takes the k-th year, from the first again after the last."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return weeks_of.withColumn("year", F.element_at(years, (k % F.size(years) + 1).cast("int")))


def feasibility(required: Column, planned: Column) -> Column:
    ratio = F.try_divide(planned, required)
    return F.when(required <= 0, "feasible").when(ratio >= 1.0, "feasible").when(ratio >= 0.70, "tight").otherwise("infeasible")
