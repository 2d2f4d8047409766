"""Texts in a language that was not learned are rejected, clean ones stay, and rare languages are learned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import langid

STEMS = {"en": "bcdfglmnprst", "de": "bdghklmnrstw", "fr": "cdfjlmnpqrsv", "es": "bcdgjlmnrtyz"}


def words(rng, letters, vowels, n):
    return " ".join("".join(rng.choice(list(letters)) + rng.choice(list(vowels)) for _ in range(rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    return [(words(rng, STEMS[y], "aeiou", int(rng.integers(5, 30))), y) for _ in range(1500) for y in STEMS]


def test_quantile_is_reached_and_unlearned_language_is_rejected(spark, sample):
    model = langid.train(sample[:5600])
    assert model.unseen_limit < 0.5  # half the way to 1, or more, where the share cannot be told
    rows = [(i, t) for i, (t, _) in enumerate(sample[5600:])]
    strange = ["Мама мыла раму и читала книги вечером у окна", "学而时习之不亦说乎 有朋自远方来不亦乐乎", "xqzv kwxj qwpt fjgh xbnm wrtx kkqz vvxk hhjw"]
    df = spark.createDataFrame(rows + [(10_000 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in langid.predict(df, model).collect()}
    assert all(got[10_000 + i] for i in range(len(strange)))
    assert np.mean([got[i] for i, _ in rows]) < 0.02


def test_sample_reaches_every_language_and_stays_bounded(spark):
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(5000 + i, f"texte {i}", "fr") for i in range(30)] + [(6000, "yksi", "fi"), (7000, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_sample(df, F.col("lang"), 200, 100)
    count = {y: sum(v == y for _, v in got) for y in ("en", "fr", "fi")}
    assert count == {"en": 169, "fr": 30, "fi": 1}
    assert langid.training_sample(df.limit(0), F.col("lang"), 200, 100) == []
