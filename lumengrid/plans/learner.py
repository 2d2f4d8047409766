"""Learner state, prescriptions and recommendations over the attempts of the tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.operators import prescribe, recommend, state
from lumengrid.plans.registry import query
from lumengrid.sources.folders import cut, dropped, shared_folder, shuffles_dropped
from lumengrid.sources.tables import VIEWS_SQL, attempts, judged, problems, table
from lumengrid.streaming import learner
from lumengrid.streaming.ingest import event_stream


def _concept() -> Column:
    """A problem's main concept: its unit and the first word of its name."""
    return F.concat_ws(":", "unit", F.element_at("tags", 1))


def _judged(spark, d) -> DataFrame:
    """Attempts with their problems and main concepts, dealt by learner."""
    return judged(spark, d, problems(spark, d).select("problem_id", "subject", _concept().alias("concept"), "limit_seconds"))


def _by_subject(spark, d) -> DataFrame:
    """All of each learner's state in each subject, in one pass."""
    return state.by_subject(judged(spark, d, state.marked(problems(spark, d), _concept()), "left"))


CONCEPT_SQL = "unit || ':' || tags[1]"
STATE_SQL = f"""WITH {VIEWS_SQL}, st AS (
  SELECT user_id, subject, count(*) AS n, count_if(correct)::BIGINT AS n_correct, count(limit_seconds) AS n_timed,
         count(*) FILTER (WHERE seconds > limit_seconds) AS n_over
  FROM v_attempt JOIN v_problem USING (problem_id) GROUP BY ALL), mastery AS (
  SELECT user_id, subject, {CONCEPT_SQL} AS concept, count(*) AS n, count_if(correct)::BIGINT AS n_correct,
         round(count_if(correct) / count(*), 4) AS mastery
  FROM v_attempt JOIN v_problem USING (problem_id) GROUP BY ALL), tag_n AS (
  SELECT user_id, subject, unnest(mistakes) AS tag FROM v_attempt JOIN v_problem USING (problem_id)), tag_c AS (
  SELECT user_id, subject, tag, count(*) AS n FROM tag_n GROUP BY ALL), tag_r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, subject ORDER BY n DESC, tag) AS r FROM tag_c), top_t AS (
  SELECT user_id, subject, list(tag ORDER BY r) AS top FROM tag_r WHERE r <= 3 GROUP BY ALL), gaps AS (
  SELECT user_id, subject, bool_or(mastery < 0.40) AS gap FROM mastery GROUP BY ALL), tags AS (
  SELECT user_id, subject, top, coalesce(n_over / nullif(n_timed, 0), 0.0) >= 0.30 AS over, coalesce(gap, false) AS gap
  FROM st LEFT JOIN top_t USING (user_id, subject) LEFT JOIN gaps USING (user_id, subject)), risk AS (
  SELECT user_id, subject, (coalesce(top, []) || CASE WHEN over THEN ['time_pressure'] ELSE [] END
         || CASE WHEN gap THEN ['concept_gap'] ELSE [] END)[1:3] AS tags FROM tags), users AS (
  SELECT user_id, count(*) AS n, count_if(correct)::BIGINT AS n_correct FROM v_attempt GROUP BY ALL), stages AS (
  SELECT *, CASE WHEN n = 0 THEN 'intro' WHEN n < 30 THEN 'post_lecture' WHEN n < 80 OR n_correct / n < 0.50 THEN 'objective_entry'
         WHEN n < 200 OR n_correct / n < 0.62 THEN 'past_exam_rotation' WHEN n < 400 OR n_correct / n < 0.72 THEN 'mock_exam'
         ELSE 'final' END AS stage FROM users)"""


@query(f"{STATE_SQL} SELECT *, round(n_correct / n, 4) AS accuracy, round(coalesce(n_over / nullif(n_timed, 0), 0.0), 4) AS overrun FROM st")
def user_subject_state(spark, d) -> DataFrame:
    """Accuracy and time overrun of each learner in each subject."""
    return state.subject_state_of(_judged(spark, d))


@query(f"{STATE_SQL} SELECT * FROM mastery")
def concept_mastery(spark, d) -> DataFrame:
    return state.concept_mastery_of(_judged(spark, d))


@query(f"{STATE_SQL} SELECT user_id, subject, tag, n FROM tag_c")
def tag_frequency(spark, d) -> DataFrame:
    return state.tag_counts_of(_judged(spark, d))


@query(f"{STATE_SQL} SELECT user_id, subject, array_to_string(tags, ',') AS tags FROM risk")
def user_risk_tags(spark, d) -> DataFrame:
    return _by_subject(spark, d).where("known").select("user_id", "subject", F.array_join("tags", ",").alias("tags"))


@query(f"{STATE_SQL} SELECT * FROM stages")
def user_stage(spark, d) -> DataFrame:
    return state.user_stage(attempts(spark, d))


WHOLE_STATE_SQL = f"""{STATE_SQL}, m AS (SELECT user_id, subject, string_agg(concept || '=' || mastery::DECIMAL(6,4), ';' ORDER BY mastery, concept) AS mastery FROM mastery GROUP BY ALL)
SELECT user_id, stage, string_agg(subject || '|' || round(st.n_correct / st.n, 4)::DECIMAL(6,4) || '|' || array_to_string(risk.tags, ',') || '|' || m.mastery, '/' ORDER BY subject) AS subject_states
FROM st JOIN risk USING (user_id, subject) JOIN m USING (user_id, subject) JOIN stages USING (user_id) GROUP BY user_id, stage"""


def _written(full: DataFrame) -> DataFrame:
    """The whole nested state as text."""

    def ratio(x: Column) -> Column:
        return x.cast("decimal(6,4)").cast("string")

    def said(s: Column) -> Column:
        mastery = F.array_join(F.transform(s["concept_mastery"], lambda m: F.concat(m["concept"], F.lit("="), ratio(m["mastery"]))), ";")
        return F.concat_ws("|", s["subject"], ratio(s["accuracy"]), F.array_join(s["tags"], ","), mastery)

    return full.select("user_id", "stage", F.array_join(F.transform("subject_states", said), "/").alias("subject_states"))


@query(WHOLE_STATE_SQL)
def user_state(spark, d) -> DataFrame:
    """The whole nested state of a learner, written out as text."""
    return _written(state.user_state_of(_by_subject(spark, d)))


@query(WHOLE_STATE_SQL)
def stream_user_state(spark, d) -> DataFrame:
    """The same, kept by deltas over a stream: most attempts come first with a wrong result and wrong mistakes for one in
    five, then all come as they are, some of them twice. Every batch has attempts of all users, so it costs what the whole
    state does; the stream comes in a few batches whatever the number of its files."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    every = f"{folder}/attempts"
    with shuffles_dropped(spark):
        attempts(spark, d).drop("attempt_at").withColumn("log_id", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(every)
    rows = spark.read.parquet(every)
    wrong = F.col("log_id") % 5 == 0
    first = rows.where("log_id % 3 > 0").withColumns({"correct": F.col("correct") != wrong, "mistakes": F.when(wrong, F.array(F.lit("x"))).otherwise(F.col("mistakes")), "version": F.lit(0)})
    for part in (first, rows.withColumn("version", F.lit(1)), first.unionByName(rows.withColumn("version", F.lit(1))).where("log_id % 7 = 0")):
        part.write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
    dropped(spark, every)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)
    files = len(spark.read.schema(schema).parquet(f"{folder}/in").inputFiles())
    stream = event_stream(spark, f"{folder}/in", schema, max(8, math.ceil(files / 4)))
    learner.maintained(stream, problems(spark, d), _concept(), f"{folder}/state", f"{folder}/checkpoint", buckets=8).awaitTermination()
    return _written(learner.current(spark, f"{folder}/state"))


# Decision rules: key, stages, subjects, tags, confidence. Empty lists fit all; group ``metals`` needs both its members.
RULES = [
    ("r1_all", [], [], [], 0.50),
    ("r2_entry", ["objective_entry", "post_lecture"], [], ["A"], 0.80),
    ("r3_metals", [], ["metals"], [], 0.72),
    ("r4_time", [], [], ["time_pressure"], 0.90),
    ("r5_gap", ["objective_entry"], ["all"], ["concept_gap"], 0.72),
    ("r6_first", [], ["ECONOMY"], ["R", "O"], None),
]
GROUPS = {"metals": ["ECONOMY", "SMALL"]}
RULES_SCHEMA = "rule_key string, stages array<string>, rule_subjects array<string>, rule_tags array<string>, confidence double"
RULES_SQL = f"""rules AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {s}::VARCHAR[], {j}::VARCHAR[], {t}::VARCHAR[], {'NULL' if c is None else c}::DOUBLE)" for k, s, j, t, c in RULES)}) AS t(rule_key, stages, rule_subjects, rule_tags, confidence)),
profile AS (SELECT user_id, list(DISTINCT subject) AS subjects, list_distinct(flatten(list(tags))) AS tags FROM risk GROUP BY user_id),
fit AS (SELECT p.user_id, rule_key, confidence FROM profile p JOIN stages s USING (user_id), rules
  WHERE (len(rules.stages) = 0 OR list_contains(rules.stages, s.stage))
    AND (len(rule_subjects) = 0 OR list_contains(rule_subjects, 'all') OR len(list_intersect(rule_subjects, p.subjects)) > 0
         OR (list_contains(rule_subjects, 'metals') AND list_has_all(p.subjects, ['ECONOMY', 'SMALL'])))
    AND (len(rule_tags) = 0 OR list_has_any(rule_tags, p.tags))),
matched AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(confidence, 0) DESC, rule_key) AS position FROM fit)"""


def _matched(spark, states: DataFrame) -> DataFrame:
    """The rules that fit each learner, from what ``state.by_subject`` gives."""
    known = F.col("known")
    profile = states.where("user_id is not null").groupBy("user_id").agg(
        F.bool_or("known").alias("known"),
        F.collect_set(F.when(known, F.col("subject"))).alias("subjects"),
        F.array_distinct(F.flatten(F.collect_list(F.when(known, F.col("tags"))))).alias("tags"),
        F.sum("n_own").alias("n"),
        F.sum("n_own_correct").alias("n_correct"),
    )
    users = profile.where("known").withColumn("stage", state.stage_of(F.col("n"), F.col("n_correct") / F.col("n")))
    return prescribe.matched_rules(users, spark.createDataFrame(RULES, RULES_SCHEMA), GROUPS)


@query(f"{STATE_SQL}, {RULES_SQL} SELECT user_id, rule_key, confidence, position FROM matched")
def rule_match(spark, d) -> DataFrame:
    return _matched(spark, _by_subject(spark, d))


@query(
    f"""{STATE_SQL}, {RULES_SQL}, mm AS (SELECT user_id, subject, avg(mastery) AS mean_mastery FROM mastery GROUP BY ALL),
pts AS (SELECT user_id, sum(CASE WHEN round(n_correct / n, 4) < 0.40 THEN 20 ELSE 0 END + CASE WHEN round(coalesce(n_over / nullif(n_timed, 0), 0.0), 4) > 0.30 THEN 15 ELSE 0 END
        + CASE WHEN mean_mastery < 0.50 THEN 15 ELSE 0 END) AS points FROM st LEFT JOIN mm USING (user_id, subject) GROUP BY user_id),
u AS (SELECT c_custkey AS user_id, c_custkey % 120 AS days, coalesce(n_rules, 0) AS n_rules FROM customer LEFT JOIN (SELECT user_id, count(*) AS n_rules FROM matched GROUP BY user_id) r ON c_custkey = r.user_id),
s AS (SELECT user_id, least(100, coalesce(points, 0) + CASE WHEN days < 30 THEN 25 WHEN days < 60 THEN 10 ELSE 0 END + CASE WHEN n_rules >= 5 THEN 20 WHEN n_rules >= 3 THEN 10 ELSE 0 END)::BIGINT AS score
      FROM u LEFT JOIN pts USING (user_id))
SELECT user_id, score, CASE WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'moderate' ELSE 'low' END AS level FROM s"""
)
def risk_score(spark, d) -> DataFrame:
    states = cut(_by_subject(spark, d).drop("concept_mastery"), "states")  # read for points and for rules
    counts = _matched(spark, states).groupBy("user_id").agg(F.count("*").alias("n_rules"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 120).alias("days"))
    return prescribe.risk_score(states.where("known"), users.join(counts, "user_id", "left").fillna({"n_rules": 0}))


@query(
    f"""{STATE_SQL}, f AS (SELECT tag, count(*) AS f FROM (SELECT unnest(tags) AS tag FROM v_problem) GROUP BY tag),
k AS (SELECT concept, coalesce(max(f), 0) AS f FROM (SELECT DISTINCT concept FROM mastery) c LEFT JOIN f ON contains(concept, tag) OR contains(tag, concept) GROUP BY concept),
i AS (SELECT user_id, concept, subject, round(0.6 * (1 - greatest(0.0, least(1.0, mastery))) + 0.4 * k.f / (SELECT max(f) FROM f), 4) AS importance FROM mastery JOIN k USING (concept)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, concept ORDER BY importance DESC, subject) AS r FROM i),
p AS (SELECT user_id, concept, subject, importance, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, concept, subject) AS position FROM b WHERE r = 1)
SELECT * FROM p WHERE position <= 3"""
)
def concept_importance(spark, d) -> DataFrame:
    p = problems(spark, d)
    frequency = cut(p.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("f")), "frequency")
    concepts = cut(p.select(_concept().alias("concept")).distinct(), "concepts")
    return prescribe.concepts_to_review(state.concept_mastery_of(_judged(spark, d)), frequency, concepts=concepts)


@query(
    f"""{STATE_SQL}, {RULES_SQL} SELECT user_id, 'rx-' || user_id || '-' || left(sha256(user_id || '|' || string_agg(rule_key, ',' ORDER BY position)), 16) AS prescription_id,
  string_agg(rule_key, ',' ORDER BY position) AS rule_keys, count(*) AS n_rules, CASE WHEN count(*) >= 10 THEN 60 WHEN count(*) >= 3 THEN 45 ELSE 30 END::BIGINT AS minutes FROM matched GROUP BY user_id"""
)
def prescription(spark, d) -> DataFrame:
    """A learner's prescription: its rules in order, an id that its content decides, and the time it takes."""
    rules = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "rule_key"))), lambda r: r["rule_key"]), ",")
    out = _matched(spark, _by_subject(spark, d)).groupBy("user_id").agg(rules.alias("rule_keys"), F.count("*").alias("n_rules"))
    return out.select(
        "user_id",
        prescribe.prescription_id(F.col("user_id"), F.concat_ws("|", F.col("user_id").cast("string"), "rule_keys")).alias("prescription_id"),
        "rule_keys",
        "n_rules",
        prescribe.minutes(F.col("n_rules")).cast("long").alias("minutes"),
    )


# What can be practised: every problem, also those of subjects in which a learner has no attempts yet (accuracy neutral).
CANDIDATES_SQL = """tried AS (SELECT DISTINCT user_id, problem_id FROM v_attempt), weak AS (SELECT DISTINCT user_id, subject, concept FROM mastery WHERE mastery < 0.5),
every AS (SELECT user_id, subject FROM (SELECT DISTINCT user_id FROM st) a, (SELECT DISTINCT subject FROM v_problem) b),
cand AS (SELECT e.user_id, p.problem_id, p.subject, round(s.n_correct / s.n, 4) AS accuracy, w.concept IS NOT NULL AS weak, t.problem_id IS NOT NULL AS attempted,
    coalesce(list_contains(r.tags, 'time_pressure'), false) AND coalesce(limit_seconds <= 90, false) AS pressed
  FROM every e LEFT JOIN st s USING (user_id, subject) LEFT JOIN risk r USING (user_id, subject) JOIN v_problem p ON p.subject = e.subject
  LEFT JOIN weak w ON w.user_id = e.user_id AND w.subject = e.subject AND w.concept = p.unit || ':' || p.tags[1]
  LEFT JOIN tried t ON t.user_id = e.user_id AND t.problem_id = p.problem_id),
scored AS (SELECT user_id, problem_id, subject, accuracy, round((1 - greatest(0.0, least(1.0, coalesce(accuracy, 0.5)))) + CASE WHEN accuracy < 0.40 THEN 1.5 ELSE 0.0 END + CASE WHEN weak THEN 0.8 ELSE 0.0 END
    - CASE WHEN attempted THEN 0.5 ELSE 0.0 END + CASE WHEN pressed THEN 0.2 ELSE 0.0 END, 4) AS score FROM cand),
best AS (SELECT user_id, problem_id, score, accuracy, subject, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, problem_id) AS position FROM scored)"""


def _best(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The five best questions of each learner, their states, and the problems."""
    p = problems(spark, d)
    a = cut(attempts(spark, d).drop("attempt_at"), "attempts")  # read by four branches
    mastery = cut(state.concept_mastery(a, p, _concept()), "mastery")
    subjects = cut(state.subject_state(a, p), "subjects")
    risk = state.tags_of(subjects, state.tag_counts(a, p), mastery).withColumnRenamed("tags", "risk")
    states = cut(subjects.select("user_id", "subject", "accuracy").join(risk, ["user_id", "subject"]), "states")
    weak = mastery.where("mastery < 0.5").select("user_id", "subject", "concept")
    tried = a.select("user_id", "problem_id").distinct()
    questions = p.select("problem_id", "subject", _concept().alias("concept"), "limit_seconds")
    rows = recommend.candidates(states, questions, weak, tried, 5)
    return recommend.top(rows, ["user_id"], [F.desc("score"), "problem_id"], 5), states, questions


@query(f"{STATE_SQL}, {CANDIDATES_SQL} SELECT user_id, problem_id, score, position FROM best WHERE position <= 5")
def recommend_topk(spark, d) -> DataFrame:
    """The five questions that each learner should practise next."""
    return _best(spark, d)[0].select("user_id", "problem_id", "score", "position")


@query(
    f"""{STATE_SQL}, {CANDIDATES_SQL}, k AS (SELECT user_id, problem_id, accuracy FROM scored WHERE accuracy >= 0.75 AND (user_id, problem_id) NOT IN (SELECT user_id, problem_id FROM best WHERE position <= 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY accuracy DESC, problem_id) AS position FROM k) SELECT * FROM r WHERE position <= 3"""
)
def skip_candidates(spark, d) -> DataFrame:
    """Up to three questions of subjects that a learner masters, none of those to practise: of a subject the first eight
    questions are enough, as five at most are to practise."""
    chosen, states, questions = _best(spark, d)
    first = recommend.top(questions.select("subject", "problem_id"), ["subject"], ["problem_id"], 8).drop("position")
    rest = states.where("accuracy >= 0.75").select("user_id", "subject", "accuracy").join(first, "subject").join(chosen.select("user_id", "problem_id"), ["user_id", "problem_id"], "left_anti")
    return recommend.top(rest, ["user_id"], [F.desc("accuracy"), "problem_id"], 3).select("user_id", "problem_id", "accuracy", "position")


@query(
    f"""WITH {VIEWS_SQL}, r AS (SELECT subject, problem_id, row_number() OVER (PARTITION BY subject ORDER BY problem_id) AS turn FROM v_problem),
o AS (SELECT subject, problem_id, row_number() OVER (ORDER BY turn, subject) AS position FROM r) SELECT * FROM o WHERE position <= 20"""
)
def cold_start_round_robin(spark, d) -> DataFrame:
    """Questions for a learner without history: one subject after another."""
    return recommend.round_robin(problems(spark, d).select("subject", "problem_id"), "subject", ["problem_id"], 20).select("subject", "problem_id", "position")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM r WHERE n = 1"""
)
def dedup_keep_first(spark, d) -> DataFrame:
    """The first line of each key in a stated order."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return recommend.first_of_each(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


@query(
    f"""{STATE_SQL}, w AS (SELECT user_id, subject, round(n_correct / n, 4) - 0.35 * round(coalesce(n_over / nullif(n_timed, 0), 0.0), 4) AS s FROM st)
SELECT user_id, arg_min(subject, (s, subject)) AS subject FROM w GROUP BY user_id"""
)
def weakest_subject(spark, d) -> DataFrame:
    """The subject with the least accuracy less a share of the overrun, the first by name on ties."""
    s = F.col("accuracy") - 0.35 * F.col("overrun")
    return state.subject_state_of(_judged(spark, d)).groupBy("user_id").agg(F.min_by("subject", F.struct(s, "subject")).alias("subject"))


@query(
    f"""{STATE_SQL}, a AS (SELECT user_id, sum(round(10000 * round(n_correct / n, 4))::BIGINT)::BIGINT AS s, count(*) AS n, max(round(coalesce(n_over / nullif(n_timed, 0), 0.0), 4)) AS max_overrun FROM st GROUP BY user_id)
SELECT user_id, round(s / (10000.0::DOUBLE * n), 6) AS mean_accuracy, max_overrun, CASE WHEN 4 * s < 10000 * n THEN 'starter' WHEN max_overrun > 0.6 THEN 'slow' ELSE 'steady' END AS kind FROM a"""
)
def learner_class(spark, d) -> DataFrame:
    """Mean accuracy, largest overrun and a ladder over both. Accuracies have four places, so they are added as integers: a
    mean at the line is at the line in whatever order rows come."""
    parts = F.round(10000 * F.col("accuracy")).cast("long")
    out = state.subject_state_of(_judged(spark, d)).groupBy("user_id").agg(F.sum(parts).alias("s"), F.count("*").alias("n"), F.max("overrun").alias("max_overrun"))
    kind = F.when(4 * F.col("s") < 10000 * F.col("n"), "starter").when(F.col("max_overrun") > 0.6, "slow").otherwise("steady")
    return out.select("user_id", F.round(F.col("s") / (10000.0 * F.col("n")), 6).alias("mean_accuracy"), "max_overrun", kind.alias("kind"))


@query(
    f"""WITH {VIEWS_SQL}, r AS (SELECT user_id, problem_id, correct, seconds > limit_seconds AS slow FROM v_attempt JOIN v_problem USING (problem_id))
SELECT user_id, CASE WHEN NOT correct THEN 'choice_elimination' WHEN slow THEN 'structure' ELSE 'reverse_check' END AS path,
  concat_ws(',', CASE WHEN NOT correct THEN 'concept_gap,distractor_trap' END, CASE WHEN slow THEN 'time_pressure' END) AS tags, count(*) AS n FROM r GROUP BY ALL"""
)
def attempt_diagnosis(spark, d) -> DataFrame:
    """The path that each attempt asks for, by right or wrong and slow or not."""
    slow = F.coalesce(F.col("seconds") > F.col("limit_seconds"), F.lit(False))
    rows = judged(spark, d, problems(spark, d).select("problem_id", "limit_seconds"))
    path = F.when(~F.col("correct"), "choice_elimination").when(slow, "structure").otherwise("reverse_check")
    tags = F.concat_ws(",", F.when(~F.col("correct"), "concept_gap,distractor_trap"), F.when(slow, "time_pressure"))
    return rows.groupBy("user_id", path.alias("path"), tags.alias("tags")).agg(F.count("*").alias("n"))

