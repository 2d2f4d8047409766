"""Warehouse steps: policies and jobs of assets, signals in text, rules from signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.functions.text import anchor, sentences

# Rights that block training, and what each kind of asset asks for.
BLOCKED = ["permission_required", "rights_check_required", "license_required"]
JOBS = {"question": "problem_parse_and_solve", "question_answer": "problem_parse_and_solve", "answer": "answer_key_alignment", "explanation": "explanation_ingestion_or_generation"}


def policy(assets: DataFrame) -> DataFrame:
    """Adds policy, job_type, status and blocker. assets: rights, source_type, kind, requested."""
    owned = (F.col("source_type") == "internal") & (F.col("rights") == "owned_generated_content")
    said = F.when(F.col("rights").isin(BLOCKED), "do_not_train_until_permission").when(owned, "train_allowed_after_review").otherwise(F.col("requested"))
    out = assets.withColumn("policy", said)
    job = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in JOBS.items() for x in pair]), F.col("kind")), F.lit("asset_review"))
    free = (F.col("source_type") == "internal") & (F.col("policy") == "train_allowed_after_review")
    status = F.when(F.col("policy") == "do_not_train_until_permission", "blocked").when(free, "queued_generation").otherwise("queued_rights_review")
    return out.withColumns({"job_type": job, "status": status, "blocker": F.when(~free, F.col("policy"))})


def first_match(text: Column, ladder: list[tuple[str, list[str]]], default: str) -> Column:
    """The first name of a ladder one of whose words the text holds."""
    out = F.lit(default)
    for name, words in reversed(ladder):
        out = F.when(sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int")) > 0, name).otherwise(out)
    return out


def signals(docs: DataFrame, keywords: list[str], kinds: list[tuple[str, list[str]]], least: int = 2, keep: int = 20) -> DataFrame:
    """doc_id, position, sentence, kind, hits, confidence, anchor: sentences with ``least`` different keywords or more, one
    for each anchor, the first ``keep`` of a document. docs: doc_id, text."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("position", "sentence"))
    hits = sum((F.contains("sentence", F.lit(k)).cast("int") for k in keywords[1:]), F.contains("sentence", F.lit(keywords[0])).cast("int"))
    rows = rows.withColumn("hits", hits).where(F.col("hits") >= least)
    rows = rows.withColumns({"kind": first_match(F.col("sentence"), kinds, "general"), "confidence": F.round(F.least(F.lit(0.92), 0.46 + 0.07 * F.col("hits")), 2), "anchor": anchor(F.col("sentence"))})
    first = W.partitionBy("doc_id", "kind", "anchor").orderBy("position")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("position"))).where(F.col("r") <= keep).drop("r")


def rules(found: DataFrame) -> DataFrame:
    """rule_key, n_signals, confidence: the mean, at most 0.95, of the signals of each kind."""
    return found.groupBy(F.col("kind").alias("rule_key")).agg(F.count("*").alias("n_signals"), F.round(F.least(F.lit(0.95), F.avg("confidence")), 2).alias("confidence"))
