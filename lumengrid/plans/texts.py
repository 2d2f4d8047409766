"""Text queries: sentences, signals, anchors, HTML, links, tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.functions import text as T
from lumengrid.operators import html, warehouse
from lumengrid.plans.registry import query
from lumengrid.sources.readers import attachment_links
from lumengrid.sources.tables import table

KEYWORDS = ["the", "and", "of", "der", "und", "que", "les", "with"]
KINDS = [("study_method", ["with", "und"]), ("subject_focus", ["que", "les"]), ("timing", ["of"])]
SENTENCES_SQL = """WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?。])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS raw FROM s), t AS (SELECT doc_id, raw, trim(regexp_replace(part, '[ \\t\\r]+', ' ', 'g')) AS sentence FROM p),
f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS position, sentence FROM t WHERE length(sentence) BETWEEN 35 AND 360)"""
HITS = " + ".join(f"contains(sentence, '{k}')::INT" for k in KEYWORDS)
SIGNALS_SQL = f"""{SENTENCES_SQL}, h AS (SELECT *, {HITS} AS hits,
  CASE WHEN contains(sentence, 'with') OR contains(sentence, 'und') THEN 'study_method' WHEN contains(sentence, 'que') OR contains(sentence, 'les') THEN 'subject_focus' WHEN contains(sentence, 'of') THEN 'timing' ELSE 'general' END AS kind,
  'sha256:' || left(sha256(sentence), 12) || '; keywords:' || array_to_string(regexp_extract_all(sentence, '([가-힣A-Za-z0-9]{{2,}})', 1)[1:10], ',') AS anchor FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, anchor ORDER BY position) AS r FROM h WHERE hits >= 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS m FROM d WHERE r = 1),
signals AS (SELECT doc_id, position, kind, hits, round(least(0.92, 0.46::DOUBLE + 0.07::DOUBLE * hits), 2) AS confidence, anchor FROM n WHERE m <= 20)"""


def _signals(spark, d) -> DataFrame:
    return warehouse.signals(table(spark, d, "documents").select("doc_id", "text"), KEYWORDS, KINDS)


@query(f"{SIGNALS_SQL} SELECT doc_id, position::INT AS position, kind, hits, confidence, anchor FROM signals")
def signal_extract(spark, d) -> DataFrame:
    """Sentences that hold two keywords or more, with kind, confidence and an anchor in place of the wording."""
    return _signals(spark, d).select("doc_id", "position", "kind", "hits", "confidence", "anchor")


@query(f"{SIGNALS_SQL} SELECT kind AS rule_key, count(*) AS n_signals, round(least(0.95, avg(confidence)), 2) AS confidence FROM signals GROUP BY kind")
def rule_confidence(spark, d) -> DataFrame:
    return warehouse.rules(_signals(spark, d))


@query(f"{SENTENCES_SQL} SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM f GROUP BY doc_id")
def sentence_split(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("SELECT doc_id, CASE WHEN contains(text, 'password') OR contains(text, 'secret') THEN 'risk' WHEN contains(text, '!!') THEN 'shouting' WHEN lang = 'fr' OR contains(text, ' | ') THEN 'table' ELSE 'plain' END AS phase, CASE WHEN lang IN ('de', 'en') THEN 'germanic' ELSE 'romance' END AS family FROM documents")
def first_match_class(spark, d) -> DataFrame:
    """Ordered first-match classifiers."""
    has = {w: F.contains("text", F.lit(w)) for w in ("password", "secret", "!!", " | ")}
    phase = F.when(has["password"] | has["secret"], "risk").when(has["!!"], "shouting").when((F.col("lang") == "fr") | has[" | "], "table").otherwise("plain")
    return table(spark, d, "documents").select("doc_id", phase.alias("phase"), F.when(F.col("lang").isin("de", "en"), "germanic").otherwise("romance").alias("family"))


@query("SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 16) AS short_hash FROM documents")
def content_hash(spark, d) -> DataFrame:
    h = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", h.alias("content_hash"), F.left(h, F.lit(16)).alias("short_hash"))


@query("SELECT page_id, array_to_string(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)), ' ') <> '' AS has_links, len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS n_links FROM pages")
def page_links(spark, d) -> DataFrame:
    """The links of a page."""
    links = F.regexp_extract_all("html", F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return table(spark, d, "pages").select("page_id", (F.size(links) > 0).alias("has_links"), F.size(links).cast("long").alias("n_links"))


@query("SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda x: regexp_matches(lower(x), '\\.(html|pdf|zip)([?#].*)?$')))) AS n_attachments FROM pages")
def page_attachments(spark, d) -> DataFrame:
    """The distinct links of a page to files of listed kinds."""
    return table(spark, d, "pages").select("page_id", F.size(attachment_links(F.col("html"), ("html", "pdf", "zip"))).cast("long").alias("n_attachments"))


@query()
def html_text(spark, d) -> DataFrame:
    """Title and text of each page, by an HTML parser; SQL cannot express it (tests hold it against examples)."""
    return html.texts(table(spark, d, "pages").select("page_id", "html"))


@query("SELECT item_id, len(regexp_extract_all(text, '[.?!]')) AS n_marks, contains(text, 'not') OR contains(text, ' no ') AS negated, CASE WHEN contains(text, 'which') THEN 'choice' WHEN contains(text, 'how') THEN 'method' ELSE 'statement' END AS kind FROM benchmark")
def question_intent(spark, d) -> DataFrame:
    """Question type by ordered tokens, and whether it is negated."""
    kind = F.when(F.contains("text", F.lit("which")), "choice").when(F.contains("text", F.lit("how")), "method").otherwise("statement")
    negated = F.contains("text", F.lit("not")) | F.contains("text", F.lit(" no "))
    return table(spark, d, "benchmark").select("item_id", F.regexp_count("text", F.lit("[.?!]")).cast("long").alias("n_marks"), negated.alias("negated"), kind.alias("kind"))


SYMBOLS = ["the", "of", "and", "shall", "rate", "que", "der", "pour", "por", "with"]


@query("SELECT item_id, array_to_string(list_filter(" + str(SYMBOLS) + ", lambda s: contains(text, s)), ',') AS signals FROM benchmark")
def stem_signals(spark, d) -> DataFrame:
    """The words of an ordered list that a stem holds."""
    words = F.array(*[F.lit(s) for s in SYMBOLS])
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.filter(words, lambda s: F.contains(F.col("text"), s)), ",").alias("signals"))


@query("WITH t AS (SELECT conv_id, turn, 'noise ```json' || chr(10) || '{\"a\": ' || turn || ', \"b\": \"' || role || '\"}' || chr(10) || '``` tail' AS said FROM conversations) SELECT conv_id, turn, regexp_extract(said, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1)->>'$.b' AS b, (regexp_extract(said, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1)->>'$.a')::BIGINT AS a FROM t")
def json_from_answer(spark, d) -> DataFrame:
    """The JSON object inside a model's answer."""
    said = F.concat(F.lit('noise ```json\n{"a": '), F.col("turn").cast("string"), F.lit(', "b": "'), "role", F.lit('"}\n``` tail'))
    found = T.json_object(said)
    return table(spark, d, "conversations").select("conv_id", "turn", F.get_json_object(found, "$.b").alias("b"), F.get_json_object(found, "$.a").cast("long").alias("a"))
