"""Term graph queries: terms are words of part names, chunks are documents, prerequisites follow halves and thirds of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.functions.text import serialized
from lumengrid.operators import graph
from lumengrid.plans.registry import query
from lumengrid.sources.tables import table

# Forms are the words of part names and some that are not words of ASCII letters; chunks, problems and tutorials are parts.
FORMS = ["현금", "C++", "IFRS-15 lease", "P/E ratio", "IFRS"]
TAILS = ["현금흐름표를 본다", "C++17 and IFRS15", "IFRS-15 leases, P/E ratios", "IFRS alone", "미현금"]
_TAIL_SQL = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN ' {t}'" for k, t in enumerate(TAILS)) + " END"
_HOLDS_SQL = "contains({0}, term) AND (NOT regexp_full_match(term, '[A-Za-z0-9]+') OR regexp_matches({0}, '(^|[^A-Za-z0-9])' || regexp_escape(term) || '($|[^A-Za-z0-9])'))"
TERMS_SQL = f"""terms AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part UNION SELECT unnest({FORMS})),
chunks AS (SELECT p_partkey AS chunk_id, [lower(p_type), string_split(p_name, ' ')[1]] AS keywords, p_name || ' of ' || p_brand || {_TAIL_SQL} AS text FROM part),
listed AS (SELECT term AS from_term, chunk_id AS to_id, term AS evidence, 2.0::DOUBLE AS weight FROM chunks JOIN terms ON list_contains(keywords, term)),
body AS (SELECT term AS from_term, chunk_id AS to_id, term AS evidence, 1.0::DOUBLE AS weight FROM chunks JOIN terms ON {_HOLDS_SQL.format('text')}),
edges AS (SELECT * FROM listed UNION ALL SELECT * FROM body WHERE (from_term, to_id) NOT IN (SELECT from_term, to_id FROM listed))"""


def _tail():
    key, out = F.col("p_partkey") % 5, F.lit(None).cast("string")
    for k, t in enumerate(TAILS):
        out = F.when(key == k, f" {t}").otherwise(out)
    return out


def _forms(spark, d) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("form"))
    forms = words.union(spark.createDataFrame([(f,) for f in FORMS], "form string")).distinct()
    return forms.select(F.col("form").alias("term_id"), F.lit(0).alias("position"), "form")


def _edges(spark, d) -> DataFrame:
    keywords = F.array(F.lower("p_type"), F.get(F.split("p_name", " "), F.lit(0)))
    chunks = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), keywords.alias("keywords"), F.concat("p_name", F.lit(" of "), "p_brand", _tail()).alias("text"))
    return graph.keyword_edges(_forms(spark, d), chunks)


@query(
    f"""WITH {TERMS_SQL}, probs AS (SELECT p_partkey AS problem_id, string_split(p_name, ' ')[1:1] AS concepts, [p_type || {_TAIL_SQL}, p_name] AS tags FROM part),
exact AS (SELECT term AS from_term, problem_id AS to_id, term AS evidence, 2.0::DOUBLE AS weight FROM probs JOIN terms ON list_contains(concepts, term)),
part_of AS (SELECT DISTINCT term AS from_term, problem_id AS to_id, term AS evidence, 1.0::DOUBLE AS weight FROM (SELECT problem_id, unnest(tags) AS tag FROM probs) JOIN terms ON {_HOLDS_SQL.format('tag')})
SELECT * FROM exact UNION ALL SELECT * FROM part_of WHERE (from_term, to_id) NOT IN (SELECT from_term, to_id FROM exact)"""
)
def tested_in_edges(spark, d) -> DataFrame:
    """Terms to problems: a required concept, or held by a tag."""
    tags = F.array(F.concat("p_type", _tail()), F.col("p_name"))
    probs = table(spark, d, "part").select(F.col("p_partkey").alias("problem_id"), F.slice(F.split("p_name", " "), 1, 1).alias("concepts"), tags.alias("tags"))
    return graph.problem_edges(_forms(spark, d), probs).select("from_term", "to_id", "evidence", "weight")


@query(
    f"""WITH {TERMS_SQL}, tut AS (SELECT p_partkey AS tutorial_id, p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_size || ' ' || 'True' || {_TAIL_SQL} || ' ' || 'None' AS text FROM part)
SELECT term AS from_term, tutorial_id AS to_id, term AS evidence, 1.0::DOUBLE AS weight FROM tut JOIN terms ON {_HOLDS_SQL.format('text')}"""
)
def explained_in_edges(spark, d) -> DataFrame:
    """Terms to tutorials: held by the text of all values of the tutorial, nested ones in their order."""
    steps = F.array(F.struct(F.col("p_brand").alias("title"), F.col("p_size").alias("n")), F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("n")))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("tutorial_id"), "p_name", steps[0].alias("step"), F.lit(True).alias("open"), F.trim(_tail()).alias("tail"), F.lit(None).cast("string").alias("none"))
    return graph.tutorial_edges(_forms(spark, d), parts.select("tutorial_id", serialized(parts).alias("text"))).select("from_term", "to_id", "evidence", "weight")


@query(f"WITH {TERMS_SQL} SELECT from_term, to_id, evidence, weight FROM edges")
def term_containment(spark, d) -> DataFrame:
    """Terms to chunks: listed as a keyword, or held by the body."""
    return _edges(spark, d)


@query(f"WITH {TERMS_SQL} SELECT weight, count(*) AS n FROM edges GROUP BY ROLLUP (weight)")
def edge_histogram(spark, d) -> DataFrame:
    return _edges(spark, d).rollup("weight").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT l_suppkey AS from_term, l_linestatus AS to_kind, l_partkey AS to_id, l_returnflag AS relation, l_quantity AS weight, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS emitted FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY from_term, to_kind, to_id, relation ORDER BY weight DESC, emitted) AS n FROM e) SELECT from_term, to_kind, to_id, relation, weight FROM r WHERE n = 1"""
)
def edge_build_dedupe(spark, d) -> DataFrame:
    """The heaviest edge of each key."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("from_term"), F.col("l_linestatus").alias("to_kind"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relation"), F.col("l_quantity").alias("weight"),
        (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey")).alias("emitted"),
    )
    return graph.best_edges(lines, ["from_term", "to_kind", "to_id", "relation"]).drop("emitted")


@query(
    """WITH e AS (SELECT l_suppkey AS from_term, CASE WHEN l_linestatus = 'O' THEN 'rag_chunk' ELSE 'problem' END AS to_kind, l_partkey AS to_id, max(l_quantity) AS weight FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY from_term, to_kind ORDER BY weight DESC, to_id) AS position FROM e) SELECT * FROM r WHERE position <= 3"""
)
def resources_top3(spark, d) -> DataFrame:
    """The three heaviest resources of each term and kind."""
    kind = F.when(F.col("l_linestatus") == "O", "rag_chunk").otherwise("problem")
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("from_term"), kind.alias("to_kind"), F.col("l_partkey").alias("to_id")).agg(F.max("l_quantity").alias("weight"))
    return graph.resources(edges, ["rag_chunk", "problem", "tutorial"])


NEEDS_SQL = """needs AS (SELECT p_partkey AS term_id, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 5 = 0 AND p_partkey < (SELECT max(p_partkey) FROM part))"""


def _needs(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, d, "part").select(key)
    top = parts.agg(F.max(key).alias("top"))
    half = parts.where("p_partkey > 1").select(key.alias("term_id"), F.expr("p_partkey div 2").alias("needs"))
    third = parts.where("p_partkey > 2").select(key.alias("term_id"), F.expr("p_partkey div 3").alias("needs"))
    after = parts.where("p_partkey % 5 = 0").join(F.broadcast(top), F.col("p_partkey") < F.col("top")).select(key.alias("term_id"), (key + 1).alias("needs"))
    return half.union(third).union(after).distinct()


@query(
    f"""WITH RECURSIVE {NEEDS_SQL}, walk AS (SELECT p_partkey AS root, p_partkey AS term_id, 0 AS depth FROM part 
  UNION SELECT root, needs, depth + 1 FROM walk JOIN needs USING (term_id) WHERE depth < 3),
m AS (SELECT root, term_id, min(depth) AS depth FROM walk GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, term_id) AS n FROM m),
y AS (SELECT a.root, needs AS term_id, b.depth, min(a.term_id) AS why FROM m a JOIN needs USING (term_id) JOIN m b ON b.root = a.root AND b.term_id = needs AND b.depth = a.depth + 1 GROUP BY ALL)
SELECT root, term_id, r.depth::INT AS depth, why, row_number() OVER (PARTITION BY root ORDER BY r.depth DESC, term_id) AS position FROM r LEFT JOIN y USING (root, term_id) WHERE n <= 12"""
)
def learning_path(spark, d) -> DataFrame:
    """What to learn before each part, at most three steps back and twelve terms."""
    roots = table(spark, d, "part").select(F.col("p_partkey").alias("root"))
    return graph.prerequisite_path(roots, _needs(spark, d)).select("root", "term_id", "depth", "why", "position")


@query(
    """WITH forms AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS form FROM part), labels AS (SELECT DISTINCT p_brand || ':' || p_name AS label FROM part UNION SELECT DISTINCT left(p_name, 3) FROM part),
v AS (SELECT label, 0 AS variant_no, label AS variant FROM labels UNION ALL SELECT label, 1, substr(label, strpos(label, ':') + 1) FROM labels WHERE contains(label, ':')),
n AS (SELECT label, variant_no, form, CASE WHEN form = variant THEN 0 WHEN contains(variant, form) THEN 1 ELSE 2 END AS rank FROM v JOIN forms ON contains(variant, form) OR contains(form, variant)),
b AS (SELECT label, form, row_number() OVER (PARTITION BY label ORDER BY variant_no, rank, CASE WHEN rank = 2 THEN length(form) ELSE -length(form) END, form) AS r FROM n) SELECT label, form AS term_id FROM b WHERE r = 1"""
)
def concept_match(spark, d) -> DataFrame:
    """Labels to terms: equal, held by, or holding a form."""
    parts = table(spark, d, "part")
    forms = parts.select(F.explode(F.split("p_name", " ")).alias("form")).distinct().withColumn("term_id", F.col("form"))
    labels = parts.select(F.concat("p_brand", F.lit(":"), "p_name").alias("label")).union(parts.select(F.left("p_name", F.lit(3)))).distinct()
    return graph.match_concepts(labels, forms)


@query("SELECT p_partkey AS from_term, p_partkey // 2 AS to_id, 'confusable_with' AS relation, p_partkey // 2 IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) AS in_seed FROM part UNION ALL SELECT p_partkey // 2, p_partkey, 'confusable_with', p_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) FROM part")
def confusable_edges(spark, d) -> DataFrame:
    """Edges both ways; those to terms outside the seed stay, and are marked."""
    parts = table(spark, d, "part")
    pairs = parts.select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))
    seed = parts.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("to_id"), F.lit(True).alias("in_seed"))
    return graph.both_ways(pairs, "confusable_with").join(seed, "to_id", "left").select("from_term", "to_id", "relation", F.coalesce("in_seed", F.lit(False)).alias("in_seed"))
