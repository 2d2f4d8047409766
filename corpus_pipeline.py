"""A corpus pipeline: language ID, near-duplicates, secrets, mixture, packing. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumengrid.llm import pipeline as P
from lumengrid.llm.common import materialize, table

STAGES = [
    ("language_id", P.keep_known_languages),
    ("near_duplicates", P.keep_one_of_each_group),
    ("secrets", P.redact_secrets),
    ("mixture", P.mix_to_weights),
    ("packing", P.pack_windows),
]

#: SQL cannot express the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written as Parquet to the shared folder and read again. Nulls,
    empty and very long texts, ties, repeated rows, an empty table and further columns: see ``lumengrid.llm.pipeline``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
