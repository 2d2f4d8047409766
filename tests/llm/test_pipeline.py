"""The pipeline, stage by stage, against what each stage's brute-force version keeps."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search_and_dedup import brute_components
from test_texts import base_spans

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline

from lumengrid.llm import mixing, packing
from lumengrid.llm.common import materialize
from lumengrid.llm.queries import token_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and its result, over the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        out.append((name, docs, result))
        docs = result
    return {name: (a, b) for name, a, b in out}


def test_names_and_columns(stages):
    assert list(stages) == ["language_id", "near_duplicates", "secrets", "mixture", "packing"]
    assert all(b.columns == COLUMNS for name, (_, b) in stages.items() if name != "packing")


def test_language_stage_keeps_clean_documents(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages["language_id"])
    gone = set(before) - set(after)
    assert all(after[i] == before[i] for i in after)
    assert len(gone) <= 0.01 * len(before) and all(len(before[i]) < 200 for i in gone)


def test_dedup_stage_keeps_one_of_each_group(stages):
    before, after = stages["near_duplicates"]
    want = {i for i, _, _, kept in brute_components([(r.doc_id, r.text) for r in before.collect()], 80) if kept}
    assert {r.doc_id for r in after.collect()} == want


def test_secret_stage_marks_every_base_span(stages):
    before, after = stages["secrets"]
    was, now = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    assert set(was) == set(now)
    for i, r in now.items():
        assert base_spans(r.text) == ""
        if not base_spans(was[i].text):
            assert r.text == was[i].text
        assert r.n_chars == len(r.text)
        assert re.sub(r"\[SECRET\]", "", r.text).strip() != "" or not was[i].text.strip()


def test_mixture_stage_follows_copies(stages):
    before, after = stages["mixture"]
    want = {r.doc_id: r.copies for r in mixing.mix_documents(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_packing_stage_holds_every_id(spark, stages):
    before, after = stages["packing"]
    encode = packing.tokenizer(token_path())
    rows = before.collect()
    total = sum(len(x) + 1 for x in encode([r.text or "" for r in rows]))
    assert after.agg(F.sum("length")).first()[0] == total
    sizes = [r.n for r in after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top")).where("n = top").collect()]
    assert len(sizes) == after.select("sequence_id").distinct().count() and max(sizes) <= 2048
    assert all(n == 2048 or n & (n - 1) == 0 for n in np.array(sizes).tolist())


def test_pipeline_survives_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "the and with of that this " * 20, "en", "src1", 1), (3, "the and with of that this " * 20, "en", "src1", 1), (None, "the and secret: abcdef0123 with", None, "src2", 1), (4, "the " * 100_000, "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
