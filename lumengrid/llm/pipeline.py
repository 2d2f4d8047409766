"""The stages of corpus_pipeline.py as functions of (spark, docs, sf_dir); all but the last keep the columns of documents.

Odd input, for all stages: other columns than COLUMNS are dropped, whatever they are called; an empty table gives an empty
one; rows that repeat go through each stage as often as they come (near-duplicates keep all rows of the document that
stays); texts are worked on whole, whatever their length. A null text, or one without a letter, is rejected by the first
stage; given to the others, it is in no group, holds no secret, counts no tokens in the mixture and is the end id alone when
packed. A null language gets the one found, a null source is a source of its own in the mixture, and a null doc_id is alone
in its group and is carried along. Ties are settled as each operator says (smallest doc_id of a group, hash order of the mixture).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import mixing, secrets
from lumengrid.llm.dedup import near_duplicates
from lumengrid.llm.langid import identify
from lumengrid.llm.packing import pack
from lumengrid.llm.queries import token_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; an unlabelled document gets the language found."""
    found = identify(docs.select(COLUMNS)).where("not rejected")
    return found.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays (all its rows, where the same doc_id and text repeat). A
    document without an id is alone and stays.

    Links hold from similarity 0.8 on (op4's contract has 0.85). 50 bands of 6 rows miss one at 0.8 with probability 3e-7."""
    gone = near_duplicates(docs, percent=80, bands=50, rows=6).where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans that hold a secret become a mark, and n_chars follows the new text."""
    found = secrets.scan(docs.select(COLUMNS))
    text = secrets.redacted(F.col("text"), F.col("spans"))
    size = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", size.cast("long")).select(COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture draws it: a document drawn twice is two rows, one not drawn is none."""
    mixed = mixing.mix_documents(docs.select(COLUMNS))
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs, token_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
