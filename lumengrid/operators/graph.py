"""A graph of terms: edges from containment, prerequisite paths of bounded depth, resources."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumengrid.functions.text import label_variants
from lumengrid.operators.passes import passes
from lumengrid.sources.folders import cut


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` touches no ASCII letter or digit."""
    around = text[start - 1 : start] + text[end : end + 1]
    return not any(c.isascii() and c.isalnum() for c in around)


def substring_pairs(needles: DataFrame, texts: DataFrame, bounded: bool = False) -> DataFrame:
    """text_id, needle: every pair of a text that contains a needle; with ``bounded``, in the sense of ``functions.text.holds``
    (a needle of ASCII letters and digits alone must not touch others).

    needles: needle (empty and null ones match nothing; repeats count once). texts: text_id (unique), text. The distinct
    needles become one automaton (goto and failure links over all of them), which goes through each text once, where it
    lies: the work is that of reading the texts, and a text makes no more rows than it holds needles. Needles beyond the
    bounds of ``passes`` make further automata, each with one more read of the texts.
    """
    kinds = dict(texts.dtypes)
    schema = StructType.fromDDL(f"text_id {kinds['text_id']}, needle string")
    arrow = to_arrow_schema(schema)
    spark = texts.sparkSession
    found = spark.createDataFrame([], schema)
    for part in passes(needles.where(F.length("needle") > 0).select("needle").distinct(), most_rows=200_000):
        held = spark.sparkContext.broadcast([r["needle"] for r in part])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for needle in held.value:
                automaton.add_word(needle, (needle, bounded and needle.isascii() and needle.isalnum()))
            automaton.make_automaton()
            for b in batches:
                ids, at, hits = b.column(0), [], []
                for i, text in enumerate(b.column(1)):
                    text = text.as_py() or ""
                    own = {needle for end, (needle, alone) in automaton.iter(text) if not alone or stands_alone(text, end + 1 - len(needle), end + 1)}
                    at += [i] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], schema=arrow)

        found = found.unionByName(texts.select("text_id", "text").mapInArrow(run, schema))
    return found


def form_edges(forms: DataFrame, listed: DataFrame, bodies: DataFrame, weight: float = 1.0) -> DataFrame:
    """from_term, to_id, weight, evidence: 2.0 where a term's form is listed for an item, else ``weight`` where a body of the
    item holds one. The evidence is the first such form by position.

    forms: term_id, position, form. listed: to_id, form. bodies: to_id, body_id (unique), text.
    """
    exact = listed.distinct().join(forms, "form")
    exact = exact.groupBy(F.col("term_id").alias("from_term"), "to_id").agg(F.min_by("form", F.struct("position", "form")).alias("evidence")).withColumn("weight", F.lit(2.0))
    texts = bodies.select(F.col("body_id").alias("text_id"), "text")
    pairs = substring_pairs(forms.select(F.col("form").alias("needle")), texts, bounded=True)
    owners = bodies.select("to_id", F.col("body_id").alias("text_id"))
    near = pairs.join(owners, "text_id").select("to_id", F.col("needle").alias("form")).distinct()
    found = near.join(forms, "form").groupBy(F.col("term_id").alias("from_term"), "to_id").agg(F.min_by("form", F.struct("position", "form")).alias("evidence"))
    rest = found.join(exact.select("from_term", "to_id"), ["from_term", "to_id"], "left_anti").withColumn("weight", F.lit(weight))
    return exact.unionByName(rest)


def keyword_edges(forms: DataFrame, chunks: DataFrame) -> DataFrame:
    """from_term, to_id, weight, evidence: 2.0 where a chunk lists a form as a keyword, else 1.0 where its body holds one.

    forms: term_id, position, form. chunks: chunk_id (unique), keywords, text."""
    listed = chunks.select(F.col("chunk_id").alias("to_id"), F.explode("keywords").alias("form"))
    return form_edges(forms, listed, chunks.select(F.col("chunk_id").alias("to_id"), F.col("chunk_id").alias("body_id"), "text"))


def problem_edges(forms: DataFrame, problems: DataFrame) -> DataFrame:
    """The same for problems: 2.0 where a form is one of the required concepts, else 1.0 where a tag holds one.

    problems: problem_id (unique), concepts, tags."""
    listed = problems.select(F.col("problem_id").alias("to_id"), F.explode("concepts").alias("form"))
    tags = problems.select(F.col("problem_id").alias("to_id"), F.posexplode("tags").alias("n", "text"))
    return form_edges(forms, listed, tags.select("to_id", F.concat_ws(":", "to_id", "n").alias("body_id"), "text"))


def tutorial_edges(forms: DataFrame, tutorials: DataFrame) -> DataFrame:
    """The same for tutorials, by their whole text alone. tutorials: tutorial_id (unique), text (see ``functions.text.serialized``)."""
    none = tutorials.select(F.col("tutorial_id").alias("to_id"), F.col("text").alias("form")).limit(0)
    return form_edges(forms, none, tutorials.select(F.col("tutorial_id").alias("to_id"), F.col("tutorial_id").alias("body_id"), "text"))


def both_ways(pairs: DataFrame, relation: str) -> DataFrame:
    """pairs: a, b. Edges from a to b and from b to a."""
    there = pairs.select(F.col("a").alias("from_term"), F.col("b").alias("to_id"))
    back = pairs.select(F.col("b").alias("from_term"), F.col("a").alias("to_id"))
    return there.unionByName(back).withColumn("relation", F.lit(relation))


def best_edges(edges: DataFrame, key: list[str], emitted: str = "emitted") -> DataFrame:
    """One edge a key: the heaviest, the first emitted on ties."""
    w = W.partitionBy(*key).orderBy(F.desc("weight"), emitted)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def match_concepts(labels: DataFrame, forms: DataFrame) -> DataFrame:
    """label, term_id: for the first variant of a label with any candidate, an equal form, else the longest form in it, else
    the shortest form that holds it; ties to the least term_id. forms: term_id, form."""
    variants = labels.select("label", F.posexplode(label_variants(F.col("label"))).alias("variant_no", "variant"))
    known = forms.where(F.length("form") >= 2)
    one, other = known.select("form").distinct(), variants.select("variant").distinct()
    held = substring_pairs(one.select(F.col("form").alias("needle")), other.select(F.col("variant").alias("text_id"), F.col("variant").alias("text"))).select(F.col("text_id").alias("variant"), F.col("needle").alias("form"))
    holding = substring_pairs(other.select(F.col("variant").alias("needle")), one.select(F.col("form").alias("text_id"), F.col("form").alias("text"))).select(F.col("needle").alias("variant"), F.col("text_id").alias("form"))
    near = held.union(holding).distinct().join(variants, "variant").join(known, "form")
    rank = F.when(F.col("form") == F.col("variant"), 0).when(F.col("variant").contains(F.col("form")), 1).otherwise(2)
    size = F.when(rank == 2, F.length("form")).otherwise(-F.length("form"))
    return near.groupBy("label").agg(F.min(F.struct("variant_no", rank.alias("rank"), size.alias("size"), "term_id")).alias("m")).select("label", "m.term_id")


def prerequisite_path(roots: DataFrame, prerequisites: DataFrame, max_depth: int = 3, max_nodes: int = 12) -> DataFrame:
    """root, term_id, depth, why, position: what to learn first. Breadth first to ``max_depth``; a term keeps its least depth
    and, as its reason, the least term of the level before that needs it (null for the root); the nearest ``max_nodes``
    stay, and the deepest come first. Cycles end with the depth.

    roots: root. prerequisites: term_id, needs. One equi-join a level; a level keeps each (root, term) once and is written, so
    the next ones do not go through the levels before it again.
    """
    prerequisites = cut(prerequisites, "needs")
    front = roots.select("root", F.col("root").alias("term_id")).distinct().withColumns({"depth": F.lit(0), "why": F.lit(None).cast(dict(roots.dtypes)["root"])})
    seen = front
    for depth in range(1, max_depth + 1):
        step = front.select("root", "term_id").join(prerequisites, "term_id").groupBy("root", F.col("needs").alias("term_id")).agg(F.min("term_id").alias("why"))
        front = cut(step.join(seen.select("root", "term_id"), ["root", "term_id"], "left_anti").select("root", "term_id", F.lit(depth).alias("depth"), "why"), "front")
        seen = seen.unionByName(front)
    near = W.partitionBy("root").orderBy("depth", "term_id")
    chosen = seen.withColumn("r", F.row_number().over(near)).where(F.col("r") <= max_nodes).drop("r")
    return chosen.withColumn("position", F.row_number().over(W.partitionBy("root").orderBy(F.desc("depth"), "term_id")))


def resources(edges: DataFrame, kinds: list[str], keep: int = 3) -> DataFrame:
    """The ``keep`` heaviest edges of each term and kind."""
    w = W.partitionBy("from_term", "to_kind").orderBy(F.desc("weight"), "to_id")
    return edges.where(F.col("to_kind").isin(kinds)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= keep)
