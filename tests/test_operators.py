"""Operators against rows worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumengrid.functions import numbers as N
from lumengrid.functions import text as T
from lumengrid.operators import folds, grade, graph, html, planning, prescribe, recommend, retrieve, solve, state, warehouse


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.fixture
def logs(spark):
    rows = [("u", "P-A1", True, 80, []), ("u", "P-A1", False, 150, ["time_pressure", "condition_miss"]), ("u", "P-A2", True, 90, []), ("u", "P-A2", False, 140, ["time_pressure"]), ("u", "P-X", True, 1, [])]
    problems = [("P-A1", "accounting", 120, ["a:one"]), ("P-A2", "accounting", 130, ["two"]), ("P-T1", "tax", None, [])]
    return (
        spark.createDataFrame(rows, "user_id string, problem_id string, correct boolean, seconds int, mistakes array<string>"),
        spark.createDataFrame(problems, "problem_id string, subject string, limit_seconds int, tags array<string>"),
    )


def test_subject_state(logs):
    (r,) = state.subject_state(*logs).collect()  # the unknown problem does not count
    assert (r.accuracy, r.overrun, r.n, r.n_over) == (0.5, 0.5, 4, 2)


def test_risk_tags_keep_the_frequent_first(logs):
    mastery = state.concept_mastery(*logs, T.main_concept(F.col("tags")))
    assert [(r.concept, r.mastery) for r in mastery.collect()] == [("a:one", 0.5)]
    (r,) = state.risk_tags(*logs, mastery).collect()
    assert r.tags == ["time_pressure", "condition_miss"]


@pytest.mark.parametrize(("n", "accuracy", "stage"), [(0, 0.9, "intro"), (29, 0.9, "post_lecture"), (79, 0.9, "objective_entry"), (500, 0.49, "objective_entry"), (500, 0.61, "past_exam_rotation"), (399, 0.9, "mock_exam"), (400, 0.72, "final")])
def test_stage_ladder(spark, n, accuracy, stage):
    assert one(spark, state.stage_of(F.lit(n), F.lit(accuracy))).c0 == stage


def test_rules_fit_by_group_wildcard_and_tag(spark):
    rules = [("all", [], [], [], 0.5), ("group", [], ["pair"], [], 0.9), ("tag", ["s"], ["any", "all"], ["x"], None), ("none", ["other"], [], [], 0.9)]
    rules = spark.createDataFrame(rules, "rule_key string, stages array<string>, rule_subjects array<string>, rule_tags array<string>, confidence double")
    users = spark.createDataFrame([(1, "s", ["a", "b"], ["x"]), (2, "s", ["a"], ["y"])], "user_id long, stage string, subjects array<string>, tags array<string>")
    got = [(r.user_id, r.rule_key, r.position) for r in prescribe.matched_rules(users, rules, {"pair": ["a", "b"]}).orderBy("user_id", "position").collect()]
    assert got == [(1, "group", 1), (1, "all", 2), (1, "tag", 3), (2, "all", 1)]


def test_recommendation_scores(spark):
    tax = recommend.score(F.lit(0.35), F.lit(False), F.lit(False), F.lit(False))
    accounting = recommend.score(F.lit(0.55), F.lit(True), F.lit(False), F.lit(False))
    unknown = recommend.score(F.lit(None).cast("double"), F.lit(False), F.lit(True), F.lit(False))
    assert tuple(one(spark, tax, accounting, unknown)) == (2.15, 1.25, 0.0)


@pytest.mark.parametrize(("votes", "choice", "top", "valid", "unanimous"), [([1, 1, 2], 1, 2, 3, False), ([2, 3, 2, 3], 2, 2, 4, False), ([None, -1], -1, 0, 0, False), ([1, None, 1], 1, 2, 2, False), ([3, 3], 3, 2, 2, True)])
def test_votes(spark, votes, choice, top, valid, unanimous):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(votes)], "q int, voter_order int, choice int")
    assert tuple(grade.plurality(rows, ["q"]).first()) == (1, choice, top, valid, unanimous)


def test_pass_status_needs_each_subject(spark):
    rows = spark.createDataFrame([("accounting", True), ("accounting", False), ("tax", False)], "subject string, correct boolean").withColumn("run", F.lit(1))
    assert grade.pass_status(rows, "subject", ["run"]).first().passed is False


def test_breaker_stops_after_a_run_of_errors(spark):
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True, True, True, False])], "k int, i int, failed boolean")
    assert grade.breaker(rows, ["k"], ["i"], 3).count() == 6


def test_learning_path_of_a_small_graph(spark):
    needs = spark.createDataFrame([("ecl", "ac"), ("ac", "eir"), ("a", "b"), ("b", "a")], "term_id string, needs string")
    roots = spark.createDataFrame([("ecl",), ("a",)], "root string")
    got = [(r.root, r.term_id, r.depth) for r in graph.prerequisite_path(roots, needs).orderBy("root", "position").collect()]
    assert got == [("a", "b", 1), ("a", "a", 0), ("ecl", "eir", 2), ("ecl", "ac", 1), ("ecl", "ecl", 0)]
    assert graph.prerequisite_path(roots, needs, max_depth=1).where("term_id = 'eir'").count() == 0


def test_containment_minds_ascii_borders(spark):
    got = one(spark, T.holds(F.lit("WACC"), F.lit("AC")), T.holds(F.lit("AC를 쓴다"), F.lit("AC")), T.holds(F.lit("유효이자율법"), F.lit("이자율")), T.holds(F.lit("a.c"), F.lit("a.c")), T.holds(F.lit("abc"), F.lit("a.c")))
    assert list(got) == [False, True, True, True, False]


def test_keyword_edge_hides_the_body(spark):
    forms = spark.createDataFrame([("t", 0, "cost"), ("u", 0, "fair value")], "term_id string, position int, form string")
    chunks = spark.createDataFrame([("c", ["cost"], "cost and fair value")], "chunk_id string, keywords array<string>, text string")
    got = sorted((r.from_term, r.weight) for r in graph.keyword_edges(forms, chunks).collect())
    assert got == [("t", 2.0), ("u", 1.0)]


def test_study_plan_weeks_and_hours(spark):
    plans = spark.createDataFrame([(1, 90, "intro"), (2, 10, "objective_entry"), (3, 0, "final")], "plan_id int, days int, stage string")
    weeks = planning.weeks(plans).where("plan_id = 1").orderBy("week").collect()
    assert (len(weeks), weeks[0].label, weeks[-1].label) == (13, "D-90~D-84", "D-6~D-0")
    counts = {(r.plan_id, r.stage): r.n_weeks for r in planning.stage_weeks(plans).collect()}
    assert sum(n for (p, _), n in counts.items() if p == 1) == 13
    assert {k: v for k, v in counts.items() if k[0] == 2} == {(2, "mock_exam"): 1, (2, "final"): 1}
    subjects = [("accounting", 0.65), ("tax", 0.35), ("business", 0.78), ("corporate_law", 0.55), ("economics", 0.60)]
    states = spark.createDataFrame([(1, s, i, a, 4.0) for i, (s, a) in enumerate(subjects)], "plan_id int, subject string, position int, accuracy double, hours_per_day double")
    hours = {r.subject: r.hours for r in planning.subject_hours(states).collect()}
    assert abs(sum(hours.values()) - 28.0) < 1e-9 and max(hours, key=hours.get) == "tax" and hours["tax"] >= 4.2 and abs(hours["business"] - 1.4) < 0.1


def test_retrieval_score(spark):
    q = F.lit("fair value of stock")
    score = retrieve.score_of(q, T.tokens(q), F.array(F.lit("Fair"), F.lit("stock price"), F.lit("none")), F.array(F.lit("value")), F.lit("the stock is up"), F.lit("unit one"), F.lit("unit"))
    assert one(spark, score).c0 == pytest.approx(2.0 + 1.0 + 0.8 + 1.5 * 1 / 4 + 0.5)
    assert one(spark, F.size(T.tokens(F.lit("!!!")))).c0 == 0


def test_answers_and_json(spark):
    row = one(spark, T.answer_index(F.lit("x ANSWER: 2 then ANSWER: 3"), F.lit(5)), T.answer_index(F.lit("ANSWER: 2, ANSWER: 3"), F.lit(5), True), T.answer_index(F.lit("ANSWER: 9"), F.lit(5)), T.json_object(F.lit('a {"k": 1} b')), T.json_object(F.lit("none")))
    assert list(row) == [1, 2, -1, '{"k": 1}', None]
    got = one(spark, T.reconciled(F.lit(" b "), F.array(F.lit("a"), F.lit("b")), F.lit(1)), T.reconciled(F.lit(None).cast("string"), F.array(F.lit("a")), F.lit(0)), T.reconciled(F.lit("z"), F.array(F.lit("a")), F.lit(0)))
    assert [tuple(x) for x in got] == [("ok", 1), ("unverified", 0), ("dropped", None)]


def test_label_variants(spark):
    assert one(spark, T.label_variants(F.lit(" a： b ")), T.label_variants(F.lit("plain")))[:] == (["a: b", "b"], ["plain"])


def test_numbers(spark):
    values = F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0))
    row = one(spark, N.nearest_choice(F.lit(2.0), values), N.nearest_choice(F.lit(2.0), F.array(F.lit(None).cast("double"))), N.money(F.lit("₩1,000 and 2억원, 30원, 7")), N.progressive_tax(F.lit(3e8)), N.calculate(F.lit("div"), F.array(F.lit(1.0), F.lit(0.0))))
    assert list(row) == [0, None, [1000.0, 2e8, 30.0], 2e8 * 0.09 + 1e8 * 0.19, None]
    d = lambda s: F.lit(dt.date.fromisoformat(s))
    assert list(one(spark, N.whole_units(d("2024-01-31"), d("2024-03-01"), "months"), N.whole_units(d("2024-02-01"), d("2024-01-01"), "days"))) == [1, None]
    rows = one(spark, N.schedule(F.lit(95000.0), F.lit(100000.0), F.lit(0.08), F.lit(0.1), F.lit(2))).c0
    assert [(r.period, r.interest, r.book) for r in rows] == [(1, 9500.0, 96500.0), (2, 9650.0, 98150.0)]


def test_formulas_abstain_or_answer(spark):
    texts = ["CAPM: risk-free 3%, beta 1.2, market return 8%", "Growth model: eps 5000, payout 0.4, required return 0.05, roe 0.2", "WACC: equity share 0.6, equity cost 0.1, debt share 0.4, debt cost 0.05, tax rate 0.2", "nothing"]
    rows = spark.createDataFrame([(i, t, [0.09, 0.076, 1.0]) for i, t in enumerate(texts)], "question_id int, text string, choices array<double>")
    bank = spark.createDataFrame([(3, 2, 0.72)], "question_id int, choice int, confidence double")
    got = {r.question_id: (r.rule_id, r.choice) for r in solve.solve(rows, bank).collect()}
    assert got == {0: ("finance_capm_required_return", 0), 1: ("unsupported", -1), 2: ("finance_wacc", 1), 3: ("known_solution_bank", 2)}


def test_policy(spark):
    rows = spark.createDataFrame([("permission_required", "official", "question", "q"), ("owned_generated_content", "internal", "answer", "q"), ("public", "official", "video", "q")], "rights string, source_type string, kind string, requested string")
    got = [(r.policy, r.job_type, r.status, r.blocker) for r in warehouse.policy(rows).collect()]
    assert got == [("do_not_train_until_permission", "problem_parse_and_solve", "blocked", "do_not_train_until_permission"), ("train_allowed_after_review", "answer_key_alignment", "queued_generation", None), ("q", "asset_review", "queued_rights_review", "q")]


def test_page_text():
    title, text = html.page_text("<html><title>A &amp; B</title><script>x<p></script><body><p>one  two</p><div>three<br>four</div></body>")
    assert (title, text) == ("A & B", "A & B \none two \nthree \nfour")
    assert html.page_text("<svg><style>x</svg>y</style></svg>z &amp;lt;") == ("", "z <")  # only the innermost closes
    assert html.page_text("<noscript>a</p>b") == ("", "") and html.page_text(None) == ("", "")
    assert html.page_text("<table><tr><td>a<td>b</tr></table><h4>c</h4><li>d<section>e</section>f") == ("", "a b \nc \nd \ne f")


def test_moving_average(spark):
    kind = "array<struct<kind:string,qty:double,price:double>>"
    moves = [("buy", 10.0, 2.0), ("buy", 10.0, 4.0), ("sell", 5.0, 0.0), ("buy", 5.0, 8.0)]
    rows = spark.createDataFrame([(1, moves), (2, [("sell", 1.0, 0.0)]), (3, [])], f"id int, moves {kind}")
    got = {r.id: r.s for r in rows.select("id", folds.moving_average(F.col("moves")).alias("s")).collect()}
    assert tuple(got[1]) == (20.0, 85.0, 15.0) and got[2] is None and tuple(got[3]) == (0.0, 0.0, 0.0)


def test_numbering_takes_small_gaps_only(spark):
    rows = [[1, 2, 9, 3, 6, 5, 7, 20, 11], [], [2, 1, 3]]
    got = spark.createDataFrame([(r,) for r in rows], "n array<bigint>").select(folds.accepted_numbers(F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == [[1, 2, 3, 6, 7, 11], [], [2, 3]]


def test_signed_items_abstain_on_unknown_ones(spark):
    item = lambda k, v: F.struct(F.lit(k).alias("label"), F.lit(v).alias("amount"))
    signs = {"loss": 1, "rise": -1}
    row = one(spark, folds.signed_total(F.lit(10.0), F.array(item("loss on sale", 3.0), item("rise of stock", 1.0)), signs), folds.signed_total(F.lit(10.0), F.array(item("other", 3.0)), signs))
    assert list(row) == [12.0, None]


def test_gross_up_fills_the_cap_with_what_is_not_eligible(spark):
    row = one(spark, folds.income_with_grossup(F.lit(1.5e7), F.lit(0.0), F.lit(1e7)), folds.income_with_grossup(F.lit(1e6), F.lit(0.0), F.lit(1e6)), folds.acquisition_with_surtaxes(F.lit(1e8), F.lit(0.04)))
    assert row.c0 == pytest.approx(2.5e7 + 5e5) and row.c1 == 2e6 and row.c2 == pytest.approx(4.6e6)


def test_traps_and_loose_matches(spark):
    traps = F.array(F.lit("net income, x"))
    row = one(spark, folds.trap_hit(traps, F.lit("the income"), F.lit(False)), folds.trap_hit(traps, F.lit("the income"), F.lit(True)), folds.trap_hit(F.lit(None).cast("array<string>"), F.lit("a"), F.lit(False)), folds.loose_match(folds.search_key(F.lit("Cash-Flow 표")), F.array(F.lit("cash flow"), F.lit("flow: zz"), F.lit("!"))))
    assert list(row) == [True, False, None, 21]


def test_closest_rate(spark):
    assert one(spark, folds.closest_rate(F.lit(100.0), F.array(F.lit(55.0), F.lit(60.5)), F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2)))).c0 == 1
