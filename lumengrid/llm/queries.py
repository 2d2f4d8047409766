"""The queries of this subpackage, each over its whole table, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import ann, chat, cotrain, kmeans, manifest, mixing, pieces, quality_rules, secrets, url_filter
from lumengrid.llm.common import table
from lumengrid.llm.dedup import near_duplicates
from lumengrid.llm.langid import identify
from lumengrid.llm.oracles import ORACLE_SQL  # noqa: F401
from lumengrid.llm.packing import pack


def token_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_pack_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), token_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return found.select("doc_id", *counts, F.sha2(secrets.said(F.col("base")), 256).alias("base_sha256"), secrets.said(F.col("spans")).alias("spans"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failures", "host_dropped")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "domain", "language", "origin", "tokens", "copies")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, manifest.leaf(*fields[:4], F.replace("text", F.lit("\n"), F.lit(""))))
    proofs = manifest.manifest(docs, "source", "doc_id", fields, [F.col("doc_id"), tampered.alias("tampered")])
    folded = manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    found = proofs.select("doc_id", "leaf", "subroot", "root", manifest.siblings_digest(F.col("path")).alias("proof_sha256"), folded)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), piece_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return pieces.decode(encoded, piece_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_block_nearest, op2_pack_min_slack, op3_secret_scan, op4_minhash_dedup, op5_quality_cotraining, op6_quality_rules, op7_url_filter, op8_mix_sources, op9_chat_format, op10_language_id, op11_merkle_manifest, op12_sentencepiece, op13_ns_bounds)}
