"""Grading, votes and reviews over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.functions import text as T
from lumengrid.operators import grade
from lumengrid.operators.numbering import numbered
from lumengrid.plans.registry import query
from lumengrid.sources.tables import VIEWS_SQL, attempts, problems, table


def _graded(spark, d) -> DataFrame:
    return attempts(spark, d).join(problems(spark, d).select("problem_id", "subject", "unit", F.col("limit_seconds").cast("string").alias("difficulty")), "problem_id")


GRADED_SQL = f"WITH {VIEWS_SQL}, g AS (SELECT a.*, subject, unit, limit_seconds::VARCHAR AS difficulty FROM v_attempt a JOIN v_problem USING (problem_id))"


@query(
    f"""{GRADED_SQL}, s AS (
SELECT 'subject' AS level, subject AS key, correct FROM g UNION ALL SELECT 'difficulty', difficulty, correct FROM g WHERE difficulty IS NOT NULL
UNION ALL SELECT 'subject/unit', subject || '/' || unit, correct FROM g UNION ALL SELECT 'all', 'all', correct FROM g)
SELECT level, key, count(*) AS total, count_if(correct)::BIGINT AS n_correct, round(count_if(correct) / count(*), 4) AS accuracy FROM s GROUP BY ALL"""
)
def group_accuracy_sets(spark, d) -> DataFrame:
    """Accuracy by four groupings in one pass."""
    return grade.grouped_accuracy(_graded(spark, d), [["subject"], ["difficulty"], ["subject", "unit"], []])


@query(
    f"""{GRADED_SQL}, s AS (SELECT user_id, subject, count(*) AS n, count_if(correct) AS c FROM g GROUP BY ALL)
SELECT user_id, count(*) AS n_subjects, bool_and(c / n >= 0.40) AND sum(c) / sum(n) >= 0.60 AS passed FROM s GROUP BY user_id"""
)
def pass_status(spark, d) -> DataFrame:
    return grade.pass_status(_graded(spark, d), "subject", ["user_id"])


def _votes(spark, d) -> DataFrame:
    """Each order is a question, its lines are voters, the vote is the quantity's remainder; three in ten abstain."""
    lines = table(spark, d, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    choice = F.when(F.col("l_partkey") % 10 < 7, (F.col("l_quantity") % 4).cast("int")).otherwise(-1)
    return lines.select(F.col("l_orderkey").alias("question_id"), F.row_number().over(order).alias("voter_order"), choice.alias("choice"))


VOTES_SQL = """WITH v AS (SELECT l_orderkey AS question_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS voter_order,
  CASE WHEN l_partkey % 10 < 7 THEN (l_quantity % 4)::INT ELSE -1 END AS choice FROM lineitem),
c AS (SELECT question_id, choice, count(*) AS n, min(voter_order) AS first FROM v WHERE choice <> -1 GROUP BY ALL),
b AS (SELECT question_id, arg_max(choice, (n, -first)) AS choice, max(n) AS n_top, sum(n)::BIGINT AS n_valid FROM c GROUP BY question_id),
a AS (SELECT question_id, count(*) AS n_all FROM v GROUP BY question_id)"""


@query(f"{VOTES_SQL} SELECT question_id, coalesce(choice, -1)::INT AS choice, coalesce(n_top, 0) AS n_top, coalesce(n_valid, 0) AS n_valid, coalesce(n_top = n_all, false) AS unanimous FROM a LEFT JOIN b USING (question_id)")
def plurality_first_seen(spark, d) -> DataFrame:
    return grade.plurality(_votes(spark, d), ["question_id"])


@query(
    f"""{VOTES_SQL} SELECT question_id, round(n_top / n_valid, 4) AS agreement, n_valid FROM b WHERE n_valid >= 2"""
)
def ensemble_agreement(spark, d) -> DataFrame:
    """How far the valid votes of a question agree, where there are two or more."""
    return grade.plurality(_votes(spark, d), ["question_id"]).where("n_valid >= 2").select("question_id", F.round(F.col("n_top") / F.col("n_valid"), 4).alias("agreement"), "n_valid")


@query(f"{GRADED_SQL} SELECT problem_id, count(*) AS n_runs, count_if(correct)::BIGINT AS n_ok, CASE WHEN count_if(correct) = count(*) THEN 'all' WHEN count_if(correct) = 0 THEN 'none' ELSE 'mixed' END AS class, 2 * count_if(correct) > count(*) AS majority FROM g GROUP BY problem_id")
def run_stability(spark, d) -> DataFrame:
    return grade.stability(_graded(spark, d).select("problem_id", F.col("correct").alias("ok")), "problem_id")


@query(
    f"""{GRADED_SQL}, r AS (SELECT subject, user_id % 3 AS run, round(count_if(correct) / count(*), 4) AS accuracy FROM g GROUP BY ALL)
SELECT subject, count(*) AS n_runs, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS deviation FROM r GROUP BY subject"""
)
def run_summary(spark, d) -> DataFrame:
    """Mean and population deviation of three runs' accuracies."""
    return grade.run_summary(_graded(spark, d).select("subject", (F.col("user_id") % 3).alias("run"), F.col("correct").alias("ok")), ["subject"])


@query(
    """SELECT role, count(*) AS n, count_if(length(text) = 0)::BIGINT AS n_empty, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean_length,
  round(count_if(contains(text, 'e')) / nullif(count_if(length(text) > 100), 0), 4) AS rate FROM conversations GROUP BY role"""
)
def quality_metrics(spark, d) -> DataFrame:
    """Lengths and rates of recorded answers."""
    n = F.length("text")
    rows = table(spark, d, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(n == 0).alias("n_empty"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean_length"),
        F.round(F.try_divide(F.count_if(F.contains("text", F.lit("e"))), F.count_if(n > 100)), 4).alias("rate"),
    )
    return rows


CITATIONS = ["(?i)article [0-9]+", "[0-9]+%", "§ ?[0-9]+", "(?i)the [a-z]+"]


@query("SELECT conv_id, turn, (" + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in CITATIONS) + ")::BIGINT AS citations FROM conversations WHERE role = 'assistant'")
def citation_count(spark, d) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.occurrences(F.col("text"), CITATIONS).cast("long").alias("citations"))


@query(
    """WITH a AS (SELECT o_orderkey AS question_id, 'So ANSWER: ' || (o_orderkey % 7) || ' or answer: ' || (o_custkey % 9) AS t FROM orders),
n AS (SELECT question_id, try_cast(regexp_extract(t, '(?i)ANSWER\\s*[:：]\\s*\\(?([0-9]+)', 1) AS INT) - 1 AS f, try_cast(regexp_extract_all(t, '(?i)ANSWER\\s*[:：]\\s*\\(?([0-9]+)', 1)[-1] AS INT) - 1 AS l FROM a)
SELECT question_id, CASE WHEN f BETWEEN 0 AND 4 THEN f ELSE -1 END::INT AS first_choice, CASE WHEN l BETWEEN 0 AND 4 THEN l ELSE -1 END::INT AS last_choice FROM n"""
)
def answer_parse(spark, d) -> DataFrame:
    """The choice that an answer line names: the first line's, and the last's."""
    said = F.concat(F.lit("So ANSWER: "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" or answer: "), (F.col("o_custkey") % 9).cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), T.answer_index(said, F.lit(5)).alias("first_choice"), T.answer_index(said, F.lit(5), True).alias("last_choice"))


@query("SELECT o_orderkey AS question_id, ('0x' || left(sha256(o_orderkey::VARCHAR), 2))::INT % 5 AS choice FROM orders")
def mock_choice(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), T.plain_choice(F.col("o_orderkey").cast("string"), F.lit(5)).alias("choice"))


@query(
    """WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'none' ELSE ' ' || string_split(p_name, ' ')[1 + (p_size % 2)] END AS answer, string_split(p_name, ' ') AS choices FROM part),
n AS (SELECT id, answer, list_position(choices, regexp_replace(answer, '\\s+', '', 'g')) - 1 AS pos FROM a)
SELECT id, CASE WHEN answer IS NULL THEN 'unverified' WHEN coalesce(pos, -1) < 0 THEN 'dropped' WHEN pos = 0 THEN 'ok' ELSE 'repaired' END AS status, CASE WHEN answer IS NULL THEN 0 WHEN pos >= 0 THEN pos END::INT AS index FROM n"""
)
def answer_key_reconcile(spark, d) -> DataFrame:
    """An answer text against its choices: whether the given key is right, can be mended, or must go."""
    words = F.split("p_name", " ")
    answer = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.concat(F.lit(" "), F.get(words, F.col("p_size") % 2)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.reconciled(answer, words, F.lit(0)).alias("r")).select("id", "r.status", "r.index")


JUDGED_SQL = "WITH j AS (SELECT doc_id, lang AS subject, source, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 1 THEN 'pass' WHEN doc_id % 2 = 0 THEN 'parse_error' ELSE 'fail' END AS verdict FROM labels JOIN documents USING (doc_id))"


def _judged(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("subject"), "source")
    verdict = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").when(F.col("doc_id") % 2 == 0, "parse_error").otherwise("fail")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "subject", "source", verdict.alias("verdict"))


@query(
    f"""{JUDGED_SQL} SELECT subject, count(*) AS total, count_if(verdict = 'pass')::BIGINT AS n_pass, count_if(verdict = 'fail')::BIGINT AS n_fail, count_if(verdict = 'parse_error')::BIGINT AS n_error,
  round(count_if(verdict = 'pass') / nullif(count_if(verdict IN ('pass', 'fail')), 0), 4) AS pass_rate FROM j GROUP BY subject"""
)
def judgment_summary(spark, d) -> DataFrame:
    """Verdicts by subject; what could not be parsed is left out of the rate."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("pass", "fail", "parse_error")}
    return _judged(spark, d).groupBy("subject").agg(
        F.count("*").alias("total"), n["pass"].alias("n_pass"), n["fail"].alias("n_fail"), n["parse_error"].alias("n_error"),
        F.round(F.try_divide(n["pass"], n["pass"] + n["fail"]), 4).alias("pass_rate"),
    )


@query(f"{JUDGED_SQL} SELECT doc_id, subject, row_number() OVER (ORDER BY doc_id) AS position FROM j WHERE verdict = 'fail' ORDER BY doc_id LIMIT 20")
def failed_samples(spark, d) -> DataFrame:
    """The first twenty failures (a report)."""
    rows = _judged(spark, d).where("verdict = 'fail'").select("doc_id", "subject").orderBy("doc_id").limit(20)
    return rows.withColumn("position", F.row_number().over(W.orderBy("doc_id")))


SEVERITIES = ["critical", "major", "minor", "uncertain"]
FINDINGS_SQL = "WITH f AS (SELECT user_id AS tutorial_id, ['critical', 'major', 'minor', 'uncertain', 'other'][1 + event_id % 5] AS severity, event_type AS category FROM events)"


def _findings(spark, d) -> DataFrame:
    kinds = F.array(*[F.lit(s) for s in [*SEVERITIES, "other"]])
    return table(spark, d, "events").select(F.col("user_id").alias("tutorial_id"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("severity"), F.col("event_type").alias("category"))


@query(
    f"""{FINDINGS_SQL}, c AS (SELECT tutorial_id, {', '.join(f"count_if(severity = '{s}')::BIGINT AS {s}" for s in SEVERITIES)}, count(*) AS findings FROM f GROUP BY tutorial_id)
SELECT *, row_number() OVER (ORDER BY CASE WHEN critical > 3 THEN 0 WHEN major > 3 THEN 1 ELSE 2 END, critical DESC, major DESC, tutorial_id) AS position FROM c"""
)
def review_queue(spark, d) -> DataFrame:
    """Severity counts of each tutorial over a fixed domain (others do not count), in the order of review."""
    counts = _findings(spark, d).groupBy("tutorial_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("findings"))
    priority = F.when(F.col("critical") > 3, 0).when(F.col("major") > 3, 1).otherwise(2)
    return numbered(counts, [priority, -F.col("critical"), -F.col("major"), F.floor(F.col("tutorial_id") / 4096)], ["tutorial_id"], "position")


@query(f"{FINDINGS_SQL} SELECT category, severity, count(*) AS n FROM f WHERE severity <> 'other' GROUP BY ALL")
def finding_crosstab(spark, d) -> DataFrame:
    return _findings(spark, d).where("severity <> 'other'").groupBy("category", "severity").agg(F.count("*").alias("n"))


@query(
    f"""{JUDGED_SQL}, e AS (SELECT doc_id, verdict, doc_id % 3 <> 0 AS verified FROM documents LEFT JOIN j USING (doc_id))
SELECT doc_id, CASE WHEN NOT verified THEN 'none' WHEN verdict = 'pass' THEN 'approved' WHEN verdict = 'fail' THEN 'rejected' ELSE 'unreviewed' END AS kind, verified AND coalesce(verdict <> 'fail', true) AS shown FROM e"""
)
def explanation_gate(spark, d) -> DataFrame:
    """Whether an explanation is shown: only verified ones, and of these all but the rejected."""
    rows = table(spark, d, "documents").select("doc_id").join(_judged(spark, d).select("doc_id", "verdict"), "doc_id", "left")
    verified, verdict = F.col("doc_id") % 3 != 0, F.col("verdict")
    kind = F.when(~verified, "none").when(verdict == "pass", "approved").when(verdict == "fail", "rejected").otherwise("unreviewed")
    return rows.select("doc_id", kind.alias("kind"), (verified & F.coalesce(verdict != "fail", F.lit(True))).alias("shown"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, value < 0.5 AS failed FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e),
r AS (SELECT *, CASE WHEN sum(failed::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) >= 5 THEN 1 ELSE 0 END AS t FROM i),
b AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT user_id, event_id, failed FROM b WHERE before = 0"""
)
def circuit_breaker(spark, d) -> DataFrame:
    """A learner's events up to the fifth failure in a row."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value") < 0.5).alias("failed"))
    return grade.breaker(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "failed")
