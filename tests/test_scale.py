"""What larger tables showed: keys of more digits, work that grew faster than its input."""

import itertools
import re

import compare
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import planning, recommend, state
from lumengrid.plans.catalog import ORACLE_SQL, QUERIES
from lumengrid.streaming.ingest import event_stream as learner_stream


def test_candidates_do_not_grow_with_the_questions(spark):
    concept = F.when(F.col("id") % 2 == 0, "a").otherwise("b")
    questions = spark.range(6000).select(F.col("id").alias("problem_id"), F.lit("x").alias("subject"), concept.alias("concept"), F.lit(100).alias("limit_seconds"))
    states = spark.createDataFrame([(1, "x", 0.5, ["A"])], "user_id long, subject string, accuracy double, risk array<string>")
    weak = spark.createDataFrame([(1, "x", "a")], "user_id long, subject string, concept string")
    tried = spark.createDataFrame([(1, 0), (1, 4)], "user_id long, problem_id long")
    rows = recommend.candidates(states, questions, weak, tried, 5)
    assert rows.count() <= 20
    best = recommend.top(rows, ["user_id"], [F.desc("score"), "problem_id"], 5).orderBy("position").collect()
    assert [(r["problem_id"], r["score"]) for r in best] == [(2, 1.3), (6, 1.3), (8, 1.3), (10, 1.3), (12, 1.3)]


def test_candidates_past_a_small_weak_concept(spark):
    concept = F.when(F.col("id") < 3, "a").otherwise("b")
    questions = spark.range(40).select(F.col("id").alias("problem_id"), F.lit("x").alias("subject"), concept.alias("concept"), F.lit(100).alias("limit_seconds"))
    states = spark.createDataFrame([(1, "x", 0.5, ["A"])], "user_id long, subject string, accuracy double, risk array<string>")
    weak = spark.createDataFrame([(1, "x", "a")], "user_id long, subject string, concept string")
    tried = spark.createDataFrame([(1, 1), (1, 3)], "user_id long, problem_id long")
    best = recommend.top(recommend.candidates(states, questions, weak, tried, 5), ["user_id"], [F.desc("score"), "problem_id"], 5).orderBy("position").collect()
    assert [(r["problem_id"], r["score"]) for r in best] == [(0, 1.3), (2, 1.3), (1, 0.8), (4, 0.5), (5, 0.5)]


def test_recovered_questions_with_keys_of_seven_digits(spark, tmp_path):
    sizes = spark.range(1_000_000, 1_000_400).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    sizes.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    con = compare.duckdb.connect()
    for t in ("part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "recovered_questions"
    assert compare.differences(spark, con, name, QUERIES[name], ORACLE_SQL[name], str(tmp_path)) == []


def test_hours_do_not_depend_on_the_order_of_rows(spark):
    orders = list(itertools.permutations(range(5)))
    rows = [(k, f"s{r}", r, (823 * 13 + r * 29) % 100 / 100, 3.0) for k, order in enumerate(orders) for r in order]
    states = spark.createDataFrame(rows, "plan_id long, subject string, position int, accuracy double, hours_per_day double").coalesce(1)
    assert planning.subject_hours(states).select("subject", "hours").distinct().count() == 5


def test_stream_comes_in_few_batches(spark, tmp_path, monkeypatch):
    from lumengrid.plans import learner

    given = []
    monkeypatch.setattr(learner, "event_stream", lambda spark, folder, schema, n: given.append((folder, n)) or learner_stream(spark, folder, schema, n))
    attempts = learner.attempts
    monkeypatch.setattr(learner, "attempts", lambda spark, d: attempts(spark, d).repartition(20))
    spark.conf.set("spark.sql.files.openCostInBytes", 2**30)  # each file is read by a task of its own
    try:
        QUERIES["stream_user_state"](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    ((folder, n),) = given
    assert len(spark.read.parquet(folder).inputFiles()) / n <= 4


BY_LEARNER = "user_subject_state concept_mastery tag_frequency user_risk_tags user_state rule_match prescription concept_importance attempt_diagnosis".split()


@pytest.mark.parametrize("rows_a_task, parts", [(500, 12), (150, 40)])  # problems broadcast, and dealt as well
@pytest.mark.parametrize("name", BY_LEARNER)
def test_learner_queries_keep_the_parts_they_were_dealt_in(spark, monkeypatch, name, rows_a_task, parts):
    from lumengrid.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", rows_a_task)
    d = "/root/testdata/sf0.001"
    assert QUERIES[name](spark, d).rdd.getNumPartitions() == parts
    assert compare.differences(spark, compare.connect(d), name, QUERIES[name], ORACLE_SQL[name], d) == []


@pytest.mark.parametrize("rows_as_read, joined", [(2_000_000, 200), (20, 300)])
@pytest.mark.parametrize("name", ["tag_frequency", "user_risk_tags"])
def test_lines_meet_orders_in_parts_that_are_written_as_read(spark, monkeypatch, name, rows_as_read, joined):
    """A task that deals its split of a file to over 200 parts holds all of it (973 MB at 6 GB)."""
    from lumengrid.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 10)
    monkeypatch.setattr(tables, "ROWS_AS_READ", rows_as_read, raising=False)
    d = "/root/testdata/sf0.001"
    plan = QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan)) == {str(joined)}
    assert set(re.findall(r"hashpartitioning\(user_id#\d+L?, (\d+)\)", plan)) == {"600"}
    assert compare.differences(spark, compare.connect(d), name, QUERIES[name], ORACLE_SQL[name], d) == []


def test_whole_state_in_one_pass_over_odd_rows(spark):
    """A problem listed twice, an unknown problem, null subjects, concepts and learners: as by separate aggregates."""
    log = [(u, p, c, s, m) for u in ("u", "v", None) for p, c, s, m in [(1, True, 50.0, ["A"]), (1, False, 150.0, ["A", "B"]), (2, True, 10.0, None), (3, False, 9.0, ["C"]), (4, True, 1.0, ["D"]), (9, True, 1.0, ["E"])]]
    log.append(("w", 9, True, 1.0, ["E"]))
    attempts = spark.createDataFrame(log, "user_id string, problem_id long, correct boolean, seconds double, mistakes array<string>")
    listed = [(1, "x", "a", 100), (1, "x", "b", 40), (2, "x", None, 5), (3, "y", None, None), (4, None, "a", 1), (None, "z", "a", 1)]
    problems = spark.createDataFrame(listed, "problem_id long, subject string, concept string, limit_seconds int")
    mastery = state.concept_mastery(attempts, problems, F.col("concept"))
    subjects, counts = state.subject_state(attempts, problems), state.tag_counts(attempts, problems)

    def plain(rows):
        return sorted(map(str, rows.collect()))

    want = state.nested(subjects, counts, mastery, state.user_stage(attempts))
    assert plain(state.user_state(attempts, problems, F.col("concept")).select(want.columns)) == plain(want)
    whole = state.by_subject(attempts.join(state.marked(problems, F.col("concept")), "problem_id", "left")).where("known")
    assert plain(whole.select("user_id", "subject", "tags")) == plain(state.risk_tags(attempts, problems, mastery))
    assert plain(whole.select(subjects.columns)) == plain(subjects)


@pytest.mark.parametrize("name", ["user_state", "risk_score"])
def test_attempts_are_joined_once(spark, monkeypatch, name):
    from lumengrid.plans import learner
    from lumengrid.sources import tables

    made = []
    joined = tables.attempts
    for module in (tables, learner):
        monkeypatch.setattr(module, "attempts", lambda spark, d: made.append(d) or joined(spark, d))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made == ["/root/testdata/sf0.001"]


def test_page_columns_takes_the_words_twice(spark, tmp_path):
    """Once for where columns part and once for the text; pages follow from counts, also where rows repeat a key."""
    texts = [(1, " ".join(f"w{i}" for i in range(500))), (1, "short\n\n text "), (2, None), (3, ""), (None, "a b"), (4, "1 2\n3")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "page_columns"
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 2
    con = compare.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.differences(spark, con, name, QUERIES[name], ORACLE_SQL[name], str(tmp_path)) == []
