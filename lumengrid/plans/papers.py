"""Exam papers: pages laid out from the words of documents, papers written from them, answer tables from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.operators import exams
from lumengrid.plans.registry import query
from lumengrid.sources.folders import cut
from lumengrid.sources.tables import dealt, table

# A page holds 240 words: two columns of 30 lines of four, slanted on every third page, or (odd pages) one column of lines of
# eight whose words may cross the middle. Each has a header word, and a number alone at the end of its left column.
WORDS_SQL = """w AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS text FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n]+') AS t FROM documents)),
p AS (SELECT doc_id AS doc, i // 240 AS page, i % 240 AS k, text FROM w),
l AS (SELECT *, CASE WHEN page % 2 = 0 THEN k // 120 ELSE 0 END AS half, CASE WHEN page % 2 = 0 THEN k % 120 // 4 ELSE k // 8 END AS line, CASE WHEN page % 2 = 0 THEN k % 4 ELSE k % 8 END AS slot FROM p),
m AS (SELECT doc, page, text, 30.0 + CASE WHEN page % 2 = 0 THEN half * (296 - 2 * (page % 4)) + slot * 62 ELSE slot * 68 END AS x0, least(6.0 * length(text), CASE WHEN page % 2 = 0 THEN 58.0 ELSE 64.0 END) AS size, 110.0 + line * 20 + CASE WHEN page % 3 = 0 THEN slot * 1.5 ELSE 0 END AS top FROM l),
words AS (SELECT doc, page, text, x0::DOUBLE AS x0, (x0 + size)::DOUBLE AS x1, top::DOUBLE AS top FROM m UNION ALL SELECT DISTINCT doc, page, 'header', 290.0::DOUBLE, 330.0::DOUBLE, 20.0::DOUBLE FROM p UNION ALL SELECT DISTINCT doc, page, '17', 40.0::DOUBLE, 52.0::DOUBLE, 720.0::DOUBLE FROM p)"""


def _page_words(spark, d) -> DataFrame:
    words = F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), "")  # [^ \n]+ at a fraction of its time
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), words.alias("t"))
    rows = texts.select("doc", F.posexplode("t").alias("i", "text")).select("doc", F.floor(F.col("i") / 240).alias("page"), (F.col("i") % 240).alias("k"), "text")
    two = F.col("page") % 2 == 0
    half, line, slot = F.when(two, F.floor(F.col("k") / 120)).otherwise(0), F.when(two, F.floor(F.col("k") % 120 / 4)).otherwise(F.floor(F.col("k") / 8)), F.when(two, F.col("k") % 4).otherwise(F.col("k") % 8)
    x0 = 30.0 + F.when(two, half * (296 - 2 * (F.col("page") % 4)) + slot * 62).otherwise(slot * 68)
    size = F.least(6.0 * F.length("text"), F.when(two, 58.0).otherwise(64.0))
    top = 110.0 + line * 20 + F.when(F.col("page") % 3 == 0, slot * 1.5).otherwise(0)
    laid = rows.select("doc", "page", "text", x0.cast("double").alias("x0"), (x0 + size).cast("double").alias("x1"), top.cast("double").alias("top"))
    # Pages follow from the number of a document's words (the most, where rows repeat its key), so no word is shuffled for them.
    counts = cut(texts.groupBy("doc").agg(F.max(F.size("t")).cast("long").alias("n")).where("n > 0"), "counts")  # read twice
    pages = counts.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 240))).alias("page"))
    extra = [F.struct(F.lit(t).alias("text"), F.lit(a).alias("x0"), F.lit(z).alias("x1"), F.lit(y).alias("top")) for t, a, z, y in (("header", 290.0, 330.0, 20.0), ("17", 40.0, 52.0, 720.0))]
    return laid.union(pages.select("doc", "page", F.inline(F.array(*extra)))).withColumns({"width": F.lit(600.0), "height": F.lit(800.0), "bottom": F.col("top") + 8})


@query(
    f"""WITH {WORDS_SQL},
tried AS (SELECT doc, page, x, count(*) FILTER (x0 < x AND x < x1) AS crossings FROM words, (SELECT unnest(range(252, 348, 2)) AS x) GROUP BY doc, page, x),
cut AS (SELECT doc, page, arg_min(x, (crossings, abs(x - 300), x)) AS split FROM tried GROUP BY doc, page),
sided AS (SELECT doc, page, text, x0, top, CASE WHEN x1 <= split THEN 0 WHEN x0 >= split AND x1 <= 600 THEN 1 END AS side FROM words JOIN cut USING (doc, page) WHERE top >= 100 AND top + 8 <= 740),
gaps AS (SELECT *, CASE WHEN top - lag(top) OVER o > 3 THEN 1 ELSE 0 END AS gap FROM sided WHERE side IS NOT NULL WINDOW o AS (PARTITION BY doc, page, side ORDER BY top, x0, text)),
islands AS (SELECT *, sum(gap) OVER (PARTITION BY doc, page, side ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS line FROM gaps),
lines AS (SELECT doc, page, side, line, string_agg(text, ' ' ORDER BY x0, text) AS text FROM islands GROUP BY doc, page, side, line)
SELECT doc, page, side, string_agg(text, chr(10) ORDER BY line) AS text FROM lines WHERE NOT regexp_matches(text, '^\\s*([0-9]+/[0-9]+|[0-9]{{1,3}}|제[0-9]교시|\\(계속\\)|[①②]형|책형|-끝-)\\s*$') GROUP BY doc, page, side"""
)
def page_columns(spark, d) -> DataFrame:
    """Columns of pages in reading order, from the places of their words."""
    return exams.page_columns(_page_words(spark, d))


HEAD = "※ 다음 자료를 이용하여 "


@query(
    f"""WITH v AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{{2,}}') AS w FROM documents),
q AS (SELECT doc_id, k // 50 AS paper, k % 50 + 1 AS number, w[24 * k + 1:24 * k + 24] AS w FROM (SELECT doc_id, w, unnest(range((len(w) + 23) // 24)) AS k FROM v)),
notes AS (SELECT doc_id, paper, CASE WHEN paper % 2 = 0 THEN '(전제: given ' || w[1] || ')' || chr(10) ELSE '' END AS note FROM q WHERE number = 1),
blocks AS (SELECT doc_id, paper, number AS a, '{HEAD}' || number || '번과 ' || (number + 1) || '번에 답하시오. ' || array_to_string(w[1:3], ' ') AS block FROM q WHERE number % 10 = 5)
SELECT q.doc_id, q.paper, number, note || coalesce(block || chr(10), '') || trim(array_to_string(w[1:9], ' ') || CASE WHEN number % 7 = 3 THEN chr(10) || '① ' || coalesce(w[10], '') || ' ② ' || coalesce(w[11], '') || ' ③ ' || coalesce(w[12], '') ELSE '' END) AS stem,
  array_to_string(list_transform(range(5), lambda c: array_to_string(w[13 + 2 * c:14 + 2 * c], ' ')), '|') AS choices, number % 7 = 3 AS split_overflow
FROM q JOIN notes USING (doc_id, paper) LEFT JOIN blocks ON blocks.doc_id = q.doc_id AND blocks.paper = q.paper AND q.number IN (a, a + 1)"""
)
def exam_questions(spark, d) -> DataFrame:
    """Papers of up to 50 questions, written from the words of documents, come apart again: shared blocks go to two questions,
    notes to all, and a stem may hold signs of choices."""
    words = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[a-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    each = words.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 24).cast("int")), lambda k: F.slice("w", k * 24 + 1, F.lit(24)))).alias("k", "w"))

    def some(first: int, n: int) -> Column:
        return F.array_join(F.slice("w", first, n), " ")

    def line(sign: str, first: int, n: int) -> Column:
        return F.concat(F.lit(f"{sign} "), some(first, n))

    number = (F.col("k") % 50 + 1).cast("string")
    note = F.when(F.col("k") % 100 == 0, F.concat(F.lit("※ 보기 중에서 고르시오.\n※ given "), some(1, 1), F.lit("\n"))).otherwise("")
    block = F.when(F.col("k") % 10 == 4, F.concat(F.lit(HEAD), number, F.lit("번과 "), (F.col("k") % 50 + 2).cast("string"), F.lit("번에 답하시오. "), some(1, 3), F.lit("\n"))).otherwise("")
    own = F.when((F.col("k") % 50 + 1) % 7 == 3, F.concat(F.lit("\n"), line("①", 10, 1), F.lit(" "), line("②", 11, 1), F.lit(" "), line("③", 12, 1))).otherwise("")
    choices = F.concat_ws(" ", *(line(c, 13 + 2 * i, 2) for i, c in enumerate(exams.CHOICES)))
    said = F.concat(note, block, number, F.lit(". "), some(1, 9), own, F.lit("\n"), choices, F.lit("\n"))
    papers = each.groupBy("doc_id", F.floor(F.col("k") / 50).alias("paper")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("t")))), lambda x: x["t"]), "").alias("text"))
    found = exams.exam_questions(papers.select(F.struct("doc_id", "paper").alias("doc"), "text"))
    return found.select("doc.*", "number", "stem", F.array_join("choices", "|").alias("choices"), "split_overflow")


@query(
    """WITH lines AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL),
c AS (SELECT (l_suppkey % 50)::VARCHAR AS subject, l_orderkey AS page, l_linenumber AS row, unnest([0, 3]) AS col, unnest([l_partkey % 40 + 1, l_partkey % 37 + 41]) AS number, unnest([['①', '2', '⑤', 'x', ''][l_quantity::INT % 5 + 1], ['③', '9', '④'][l_quantity::INT % 3 + 1]]) AS token FROM lines),
x AS (SELECT *, CASE WHEN token IN ('①', '1') THEN 0 WHEN token IN ('②', '2') THEN 1 WHEN token IN ('③', '3') THEN 2 WHEN token IN ('④', '4') THEN 3 WHEN token IN ('⑤', '5') THEN 4 END AS answer FROM c),
a AS (SELECT subject, number, arg_max(answer, (page, row, col)) AS cell FROM x WHERE answer IS NOT NULL GROUP BY subject, number),
t AS (SELECT (l_suppkey % 50)::VARCHAR AS subject, l_partkey % 90 + 1 AS number, arg_min(l_quantity::INT % 5, (l_orderkey, l_linenumber)) AS line FROM lines WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT subject, number::INT AS number, coalesce(cell, line)::INT AS answer, cell IS NULL AS from_line FROM a FULL JOIN t USING (subject, number)"""
)
def answer_grid(spark, d) -> DataFrame:
    """Answer keys from tables of (number, answer, other form), and from lines where no table has them; numbers repeat."""
    every = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_linestatus")
    count = every.count()  # from the footers of the files
    lines = dealt(every, count, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity", "l_linestatus")))
    lines = lines.select((F.col("l_suppkey") % 50).cast("string").alias("subject"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), "l_partkey", F.col("l_quantity").cast("int").alias("n"), "l_linestatus")

    def one_of(*tokens: str) -> Column:
        return F.element_at(F.array(*(F.lit(t) for t in tokens)), F.col("n") % len(tokens) + 1)

    texts = F.array((F.col("l_partkey") % 40 + 1).cast("string"), one_of("①", "2", "⑤", "x", ""), F.lit("①"), (F.col("l_partkey") % 37 + 41).cast("string"), one_of("③", "9", "④"), F.lit("1"))
    cells = lines.select("subject", "page", F.lit(0).alias("grid"), "row", F.posexplode(texts).alias("col", "text"))
    said = F.concat((F.col("l_partkey") % 90 + 1).cast("string"), F.lit(" "), one_of(*exams.CHOICES), F.lit(" ②"))
    return exams.answer_keys(cells, lines.where("l_linestatus = 'O'").select("subject", "page", F.col("row").alias("line"), said.alias("text")))
