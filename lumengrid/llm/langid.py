"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the runs of 1 to 4 bytes of a text whose ASCII letters are lower-cased and whose other ASCII bytes count as
blanks (runs of blanks as one). Each run is hashed into ``buckets`` rows of an embedding table; a text is the mean of its
rows, and a softmax over a linear map of that mean gives the languages. For prediction the table and the map are folded
into one table of logits, so whole texts of any length take one gather and one sum.

The sample is shared out by language, so a rare one is learned from all its rows or from as many as any other.

Calibration: on a part of the sample that training did not see, a temperature is chosen by likelihood, and two limits. The
score under which ``reject_share`` of rightly labelled texts fall, 0.5 at most (half the least such score, if they are too few
to tell), and the share of subwords that training never saw which ``reject_share`` of them exceed (half the way from the
largest such share to 1, if they are too few). Scores only compare the learned languages; the second limit is what
finds a text in none of them. Unseen subwords are told by a hash that is ``FINER`` times as fine as the embedding's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import free_name
from lumengrid.llm.wordhash import factors, whole_texts

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_MIX = (factors(8, 31) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)

#: A small sample is gone over until it has had so many steps.
LEAST_STEPS = 8000
#: Buckets in which a subword counts as seen or not, for each bucket of the embedding.
FINER = 64
#: Rows that each language may give to the sample, however many languages there are.
LEAST_ROWS = 50


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray  # bits, one for each of buckets * FINER: whether training saw such a subword
    unseen_limit: float


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, text number) of each byte that counts: letters lower-cased, and the first blank of a run."""
    c = _CLASS[data]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    return c[keep], doc[keep]


def hashed(c: np.ndarray, doc: np.ndarray, buckets: int, longest: int = 4, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of each run of 1 to ``longest`` folded bytes inside one text that begins at one of the first
    ``starts`` places (anywhere, unless given), ordered by run length, then place."""
    found, owner = [], []
    c = c.astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, longest + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * _MIX[n]
        same = doc[: len(doc) - n + 1] == doc[n - 1 :]
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x85EBCA6B)
        x = x ^ (x >> np.uint32(13))
        found.append((x % np.uint32(buckets))[:starts][same[:starts]])
        owner.append(doc[: len(doc) - n + 1][:starts][same[:starts]])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owner)


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of each run of 1 to ``longest`` bytes inside one text, ordered by run length, then place."""
    return hashed(*folded(data, offsets), buckets, longest)


def parts(data: np.ndarray, offsets: np.ndarray, buckets: int, most: int = 1 << 20, longest: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``subwords`` some at a time: parts overlap by ``longest`` - 1 places, and each run counts in the part it begins in."""
    c, doc = folded(data, offsets)
    for a in range(0, max(len(c), 1), most):
        yield hashed(c[a : a + most + longest - 1], doc[a : a + most + longest - 1], buckets, longest, most)


def _quota(counts: list[int], rows: int) -> int:
    """Rows that each language may give, so that all give ``rows`` at most (LEAST_ROWS each in any case)."""
    left, quota = rows, rows
    for k, n in enumerate(sorted(counts)):
        quota = left // (len(counts) - k)
        if n > quota:
            break
        left -= n
    return max(quota, LEAST_ROWS)


def training_sample(docs: DataFrame, label: Column, rows: int, chars: int) -> list[tuple[str, str]]:
    """(text, label) of up to ``rows`` rows, shared out evenly by label (a label with fewer rows gives all), those with the
    least hashes of each, each a window of up to ``chars`` characters at a hashed place: the sample that goes to the driver
    is at most rows * chars characters (LEAST_ROWS * chars a label, if these are more), whatever the corpus."""
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    known = docs.where(label.isNotNull()).select("doc_id", F.substring("text", (place + 1).cast("int"), F.lit(chars)).alias("t"), label.alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # reads no texts
    if not counts:
        return []
    quota = _quota(list(counts.values()), rows)
    # a bound on the hash lets only some rows more than the quota of each label leave the tasks
    bound = {y: int(min(1.0, (1.1 * quota + 6 * quota**0.5) / n) * (1 << 40)) if n > quota else 1 << 40 for y, n in counts.items()}
    h = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40))
    near = known.where(h < F.element_at(F.create_map(*[F.lit(x) for pair in bound.items() for x in pair]), F.col("y")))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(h, "doc_id", "t"))
    picked = near.withColumn("r", rank).where((F.col("r") <= quota) & F.col("t").isNotNull())
    return [(r.t, r.y) for r in sorted(picked.select("doc_id", "t", "y").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.t, r.y))]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, str]], buckets: int = 1 << 16, dims: int = 16, epochs: int = 4, rate: float = 0.5, reject_share: float = 0.0005, seed: int = 1) -> LanguageModel | None:
    """None if the sample has no labelled text."""
    languages = sorted({y for _, y in sample})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (buckets, dims)).astype(np.float32) / dims
    head, bias = np.zeros((dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    sample = [(t, y) for t, y in sample if re.search("[A-Za-z\x80-\U0010ffff]", t)]  # without one, a text is blanks
    labels = [languages.index(y) for _, y in sample]
    # a fifth is held out, and two fifths of a sample that is then large enough to tell reject_share
    parts = 2 if 2 * len(sample) * reject_share > 5 else 1
    fit = [k for k in range(len(sample)) if k % 5 >= parts] or list(range(len(sample)))
    held = [k for k in range(len(sample)) if k % 5 < parts]
    if not fit:
        return None

    def runs(which: list[int]):
        """(first text, subwords by the finer hash, text number) of the chosen texts, some at a time."""
        for i, data, offsets in whole_texts(pa.array([sample[k][0] for k in which], pa.string()), 1 << 17):
            yield i, len(offsets) - 1, *subwords(data, offsets, buckets * FINER)

    seen = np.zeros(buckets * FINER, bool)
    flat = []  # a few large arrays, which go back to the system when training ends
    for i, _, fine, doc in runs(fit):
        seen[fine] = True
        both, count = np.unique(doc.astype(np.int64) * buckets + fine % buckets, return_counts=True)
        flat.append(((both % buckets).astype(np.uint32), count.astype(np.float32), both // buckets + i))
        del fine, doc, both, count
    buckets_of, counts_of, rows = (np.concatenate(x) for x in zip(*flat, strict=True))
    del flat
    cuts = [*np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]).tolist(), len(rows)]

    def part(j: int):
        a, b = cuts[j], cuts[j + 1]
        return buckets_of[a:b], counts_of[a:b]

    epochs = max(epochs, -(-LEAST_STEPS // len(fit)))
    step, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            (bucket, count), y = part(j), labels[fit[j]]
            share = (count / count.sum()).astype(np.float32)
            mean = share @ table[bucket]
            error = _softmax(mean @ head + bias)
            error[y] -= 1
            now = np.float32(rate * (1 - step / total))
            back = head @ error
            head -= now * np.outer(mean, error)
            bias -= np.float32(0.1) * now * error
            table[bucket] -= (now * len(bucket) ** 0.5) * share[:, None] * back[None, :]
            step += 1
    logits = table @ head
    z, unseen = np.zeros((len(held), len(languages))), np.zeros(len(held))
    for i, n, fine, doc in runs(held):
        size = np.bincount(doc, minlength=n)
        for k in range(len(languages)):
            z[i : i + n, k] = np.bincount(doc, logits[:, k][fine % buckets], n) / size + bias[k]
        unseen[i : i + n] = np.bincount(doc[~seen[fine]], minlength=n) / size
    y = np.array([labels[k] for k in held], int)
    scales = np.geomspace(0.05, 5, 40)
    losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() if len(y) else 0 for t in scales]
    temperature = float(scales[int(np.argmin(losses))]) if len(y) else 1.0
    p = _softmax(z / temperature) if len(y) else z
    rightly = p.argmax(axis=1) == y if len(y) else np.zeros(0, bool)
    right, unseen = p.max(axis=1)[rightly] if len(y) else np.zeros(0), unseen[rightly]
    few = int(reject_share * (len(right) + 1))  # rightly labelled texts that may be rejected; without one, half the least score
    threshold = float(min(0.5, np.sort(right)[few - 1] if few else right.min() / 2)) if len(right) else 0.0
    unseen_limit = float(np.sort(unseen)[-few] if few else (1 + unseen.max()) / 2) if len(unseen) else 1.0
    return LanguageModel(languages, logits, bias, temperature, threshold, np.packbits(seen), unseen_limit)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected, from ``text`` alone (columns of these names are replaced).

    A null text, or one without a letter, gets ``und``, score 0 and rejected true. Other texts get a learned language, and
    rejected says that the score is under the threshold or the share of unseen subwords over its limit; where nothing could
    be learned they get ``und``, score 0 and rejected false.
    """
    buckets = len(model.logits) if model else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, known = model.logits.astype(np.float32), np.unpackbits(model.seen).view(bool)
        for batch in batches:
            n = batch.num_rows
            sums, seen, unseen = np.zeros((n, len(model.languages))), np.zeros(n), np.zeros(n)
            for i, data, offsets in whole_texts(batch.column(place), 1 << 18):
                m = len(offsets) - 1
                for fine, doc in parts(data, offsets, buckets * FINER):  # a very long text comes alone and goes in parts, whose sums add up
                    unseen[i : i + m] += np.bincount(doc[~known[fine]], minlength=m)
                    bucket = fine % np.uint32(buckets)
                    for k in range(len(model.languages)):
                        sums[i : i + m, k] += np.bincount(doc, logits[:, k][bucket], m)
                    seen[i : i + m] += np.bincount(doc, minlength=m)
            p = _softmax((sums / np.maximum(seen, 1)[:, None] + model.bias) / model.temperature)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([model.languages[k] for k in p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1), pa.float64()), pa.array(unseen / np.maximum(seen, 1), pa.float64())],
                [*batch.schema.names, "lang_pred", "score", share],
            )

    out = docs.drop("lang_pred", "score", "rejected")
    unknown = ~F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if model is None:
        return out.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": unknown})
    names = out.columns
    share, none = (free_name(names, n) for n in ("unseen", "unknown"))
    marked = out.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names], unknown.alias(none))
    place, schema = names.index("text"), marked.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), share: F.lit(0.0)}).schema
    scored = marked.mapInArrow(run, schema)
    return scored.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(F.col(none), "und").otherwise(F.col("lang_pred")).alias("lang_pred"),
        F.when(F.col(none), 0.0).otherwise(F.col("score")).alias("score"),
        (F.col(none) | (F.col("score") < model.threshold) | (F.col(share) > model.unseen_limit)).alias("rejected"),
    )


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null doc_id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def identify(docs: DataFrame, sample_rows: int = 6000, sample_chars: int = 1500) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred, score, rejected.

    Learns from rows that are not held out and have a lang: at most ``sample_rows`` windows of ``sample_chars`` characters.
    Predictions see the whole text and nothing else. An empty table gives no rows.
    """
    model = train(training_sample(docs.where(~held_out(F.col("doc_id"))), F.col("lang"), sample_rows, sample_chars))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
