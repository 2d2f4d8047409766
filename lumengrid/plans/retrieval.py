"""Retrieval queries: chunks are documents, queries are benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.functions.text import tokens
from lumengrid.operators import graph, retrieve
from lumengrid.plans.registry import query
from lumengrid.sources.tables import table

TOKENS_SQL = "list_distinct(regexp_extract_all(lower({0}), '([가-힣A-Za-z0-9]{{2,}})', 1))"
# A chunk is a document: its subject is its language (general for one in four), its unit and first tag its source, its
# keywords the words it begins with. A query is an item with a language and a source to look in; one in five has no subject.
# A term is the word an item begins with, also written in capitals; it is confusable with the next of the same letter.
TABLES_SQL = f"""c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'general' ELSE lang END AS subject, source AS unit, list_filter(string_split(text, ' ')[1:3], lambda x: x <> '') AS keywords, text FROM documents),
chunks AS (SELECT *, [unit, 'topic ' || coalesce(keywords[1], '')] AS tags, {TOKENS_SQL.format('text')} AS body FROM c),
terms AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z]{{2,}})', 1) AS term_id FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]{{2,}}')),
forms AS (SELECT DISTINCT term_id, unnest([term_id, upper(term_id)]) AS form FROM terms),
confusable AS (SELECT term_id, other FROM (SELECT term_id, lead(term_id) OVER (PARTITION BY left(term_id, 1) ORDER BY term_id) AS other FROM terms) WHERE other IS NOT NULL),
items AS (SELECT item_id AS query_id, text, CASE WHEN item_id % 5 > 0 THEN ['en', 'de', 'fr', 'es'][1 + item_id % 4] END AS subject, 'src' || (item_id % 20) AS unit FROM benchmark),
matched AS (SELECT DISTINCT query_id, term_id FROM items JOIN forms ON contains(text, form) AND regexp_matches(text, '(^|[^A-Za-z0-9])' || form || '($|[^A-Za-z0-9])')),
near AS (SELECT * FROM matched UNION SELECT query_id, other FROM matched JOIN confusable USING (term_id)),
more AS (SELECT query_id, string_agg(form, ' ' ORDER BY form) AS forms FROM (SELECT DISTINCT query_id, form FROM near JOIN forms USING (term_id)) GROUP BY query_id),
wide AS (SELECT items.* REPLACE (CASE WHEN forms IS NULL THEN text ELSE text || ' ' || forms END AS text) FROM items LEFT JOIN more USING (query_id))"""
PAIRS_SQL = f"""pairs AS (SELECT query_id, chunk_id, round(list_sum(list_transform(keywords, lambda k: CASE WHEN contains(q.text, k) OR contains(q.text, lower(k)) THEN 2.0 WHEN list_has_any({TOKENS_SQL.format('k')}, q.tokens) THEN 1.0 ELSE 0.0 END) || [0.0])
    + list_sum(list_transform(tags, lambda t: CASE WHEN list_has_any({TOKENS_SQL.format('t')}, q.tokens) THEN 0.8 ELSE 0.0 END)) + 1.5 * len(list_intersect(body, q.tokens)) / len(q.tokens)
    + CASE WHEN q.unit = c.unit THEN 1.0 WHEN contains(q.unit, c.unit) OR contains(c.unit, q.unit) THEN 0.5 ELSE 0.0 END, 4)::DOUBLE AS score
  FROM (SELECT *, {TOKENS_SQL.format('text')} AS tokens FROM __ROWS__) q, chunks c WHERE len(q.tokens) > 0 AND (q.subject IS NULL OR c.subject IN ('general', q.subject)))"""
BEST_SQL = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM {0} WHERE score >= 0.5) WHERE position <= 3)"


def _chunks(spark, d) -> DataFrame:
    keywords = F.filter(F.slice(F.split("text", " "), 1, 3), lambda x: x != "")
    subject = F.when(F.col("doc_id") % 4 == 0, "general").otherwise(F.col("lang"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), subject.alias("subject"), F.col("source").alias("unit"), keywords.alias("keywords"), "text")
    return rows.withColumn("tags", F.array("unit", F.concat(F.lit("topic "), F.coalesce(F.get("keywords", F.lit(0)), F.lit("")))))


def _queries(spark, d) -> DataFrame:
    key = F.col("item_id")
    subject = F.when(key % 5 > 0, F.get(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (key % 4).cast("int")))
    return table(spark, d, "benchmark").select(key.alias("query_id"), "text", subject.alias("subject"), F.concat(F.lit("src"), (key % 20).cast("string")).alias("unit"))


def _terms(spark, d) -> tuple[DataFrame, DataFrame]:
    terms = table(spark, d, "benchmark").select(F.regexp_extract("text", "^([A-Za-z]{2,})", 1).alias("term_id")).where("term_id <> ''").distinct()
    forms = terms.select("term_id", F.explode(F.array_distinct(F.array("term_id", F.upper("term_id")))).alias("form"))
    other = F.lead("term_id").over(W.partitionBy(F.left("term_id", F.lit(1))).orderBy("term_id"))
    return forms, terms.withColumn("other", other).where("other is not null")


def _boosted(spark, d) -> DataFrame:
    """The best chunks of each query that is widened by its terms, with half a point for chunks that define one."""
    queries, chunks, (forms, confusable) = _queries(spark, d), _chunks(spark, d), _terms(spark, d)
    defined = graph.keyword_edges(forms.withColumn("position", F.lit(0)), chunks.select("chunk_id", "keywords", "text"))
    terms = retrieve.matched_terms(queries, forms)
    pairs = terms.join(defined, F.col("term_id") == F.col("from_term")).select("query_id", F.col("to_id").alias("chunk_id")).distinct()
    return retrieve.retrieve(retrieve.expansions(queries, forms, confusable), chunks, pairs)


@query(f"WITH {TABLES_SQL}, {PAIRS_SQL.replace('__ROWS__', 'items')}, {BEST_SQL.format('pairs')} SELECT * FROM best")
def retrieve_topk(spark, d) -> DataFrame:
    """The three best chunks of each query by keywords, tags, words and unit, within its subject."""
    return retrieve.retrieve(_queries(spark, d), _chunks(spark, d))


BOOSTED_SQL = f"""{TABLES_SQL}, {PAIRS_SQL.replace('__ROWS__', 'wide')}, defined AS (SELECT DISTINCT term_id, chunk_id FROM forms JOIN chunks ON list_contains(keywords, form) OR contains(text, form) AND regexp_matches(text, '(^|[^A-Za-z0-9])' || form || '($|[^A-Za-z0-9])')),
hit AS (SELECT DISTINCT query_id, chunk_id FROM matched JOIN defined USING (term_id)),
lifted AS (SELECT query_id, chunk_id, round(score + CASE WHEN hit.query_id IS NULL THEN 0.0 ELSE 0.5 END, 4)::DOUBLE AS score FROM pairs LEFT JOIN hit USING (query_id, chunk_id)), {BEST_SQL.format('lifted')}"""


@query(f"WITH {BOOSTED_SQL} SELECT * FROM best")
def graph_boost(spark, d) -> DataFrame:
    """The same with queries widened by their terms, and half a point more for chunks that define one of them."""
    return _boosted(spark, d)


@query(f"WITH {TABLES_SQL} SELECT query_id, text AS expanded FROM wide")
def query_expansion(spark, d) -> DataFrame:
    """Queries with the forms of the terms they hold, and of those confusable with them."""
    forms, confusable = _terms(spark, d)
    return retrieve.expansions(_queries(spark, d), forms, confusable).select("query_id", F.col("text").alias("expanded"))


@query("SELECT item_id, len(regexp_extract_all(lower(text), '([가-힣A-Za-z0-9]{2,})', 1)) AS n_tokens, array_to_string(regexp_extract_all(lower(text), '([가-힣A-Za-z0-9]{2,})', 1), ' ') AS tokens FROM benchmark")
def tokenize(spark, d) -> DataFrame:
    t = tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"WITH {BOOSTED_SQL} SELECT query_id, string_agg('[' || chunk_id || '] ' || left(text, 40), chr(10) || chr(10) ORDER BY position) AS context FROM best JOIN chunks USING (chunk_id) GROUP BY query_id")
def context_block(spark, d) -> DataFrame:
    """The best chunks of a query as one text."""
    best = _boosted(spark, d).join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return retrieve.context(best, ["query_id"], ["position"], F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.left("text", F.lit(40))))
