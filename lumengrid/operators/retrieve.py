"""Keyword retrieval with graph boosts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumengrid.functions.text import TOKEN, tokens
from lumengrid.operators.graph import substring_pairs
from lumengrid.operators.passes import passes


def score_of(query: Column, query_tokens: Column, keywords: Column, tags: Column, body: Column, unit: Column, query_unit: Column) -> Column:
    """One chunk's score for one query: keywords, tags, shared words of the body, unit. Repeated keywords count repeatedly."""

    def keyword(k: Column) -> Column:
        return F.when(F.contains(query, k) | F.contains(query, F.lower(k)), 2.0).when(F.arrays_overlap(tokens(k), query_tokens), 1.0).otherwise(0.0)

    listed = F.aggregate(keywords, F.lit(0.0), lambda s, k: s + keyword(k))
    tagged = F.aggregate(tags, F.lit(0.0), lambda s, t: s + F.when(F.arrays_overlap(tokens(t), query_tokens), 0.8).otherwise(0.0))
    shared = F.size(F.array_intersect(tokens(body), query_tokens)) / F.greatest(F.size(F.array_distinct(query_tokens)), F.lit(1))
    units = F.when(unit == query_unit, 1.0).when(F.contains(unit, query_unit) | F.contains(query_unit, unit), 0.5).otherwise(0.0)
    return F.round(listed + tagged + 1.5 * F.least(shared, F.lit(1.0)) + F.coalesce(units, F.lit(0.0)), 4)


TOKENS = re.compile(TOKEN)
#: Cells (chunks x queries) of one block of mark scores.
CELLS = 2_000_000
#: Marks whose impacts a task remembers before it starts anew.
MOST_MARKS = 200_000


def words_of(text: str | None) -> list[str]:
    """The distinct tokens of a text."""
    return list(dict.fromkeys(t.lower() for t in TOKENS.findall(text or "")))


class Postings:
    """The queries of one pass, indexed by what can match them: words, substrings, units. An impact list names the queries
    that a mark of a chunk (keyword, tag, unit) gives points to; lists are made when a mark is first met."""

    def __init__(self, rows: list[tuple]):
        asked = [(*r, words_of(r[1])) for r in rows]
        self.rows = [r for r in asked if r[4]]  # a query without a word finds nothing
        self.number = {r[0]: i for i, r in enumerate(self.rows)}
        self.n = np.array([len(r[4]) for r in self.rows], np.float64)
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(self.rows):
            for w in r[4]:
                by_word.setdefault(w, []).append(i)
        self.by_word = {w: np.array(i, np.int64) for w, i in by_word.items()}
        self.texts = "\n".join(r[1].replace("\n", "\r") for r in self.rows)
        self.starts = np.cumsum([0, *(len(r[1]) + 1 for r in self.rows)])
        self.subjects: dict[str | None, np.ndarray] = {}
        self.known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def holding(self, part: str) -> np.ndarray:
        """Queries whose text contains ``part``: occurrences in all texts at once, a line each."""
        if not part:
            return np.arange(len(self.rows))
        if "\n" in part or "\r" in part:
            return np.array([i for i, r in enumerate(self.rows) if part in r[1]], np.int64)
        found, at = [], self.texts.find(part)
        while at >= 0:
            i = int(np.searchsorted(self.starts, at, "right")) - 1
            found.append(i)
            at = self.texts.find(part, self.starts[i + 1])
        return np.array(found, np.int64)

    def sharing(self, text: str) -> np.ndarray:
        lists = [self.by_word[w] for w in words_of(text) if w in self.by_word]
        return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)

    def impacts(self, kind: str, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """(queries, points) of a keyword, a tag or a unit."""
        if (kind, mark) not in self.known:
            if len(self.known) > MOST_MARKS:
                self.known.clear()
            points = np.zeros(len(self.rows))
            if kind == "tag":
                points[self.sharing(mark)] = 0.8
            elif kind == "keyword":
                points[self.sharing(mark)] = 1.0
                points[self.holding(mark)] = points[self.holding(mark.lower())] = 2.0
            else:
                for i, r in enumerate(self.rows):
                    if r[3] is not None:
                        points[i] = 1.0 if mark == r[3] else 0.5 if mark in r[3] or r[3] in mark else 0.0
            hit = np.flatnonzero(points)
            self.known[kind, mark] = hit, points[hit]
        return self.known[kind, mark]

    def barred(self, subject: str | None) -> np.ndarray:
        """Queries that a chunk of this subject does not answer."""
        if subject not in self.subjects:
            self.subjects[subject] = np.array([i for i, r in enumerate(self.rows) if r[2] is not None and subject not in ("general", r[2])], np.int64)
        return self.subjects[subject]

    def shared(self, text: str | None) -> np.ndarray:
        """How many of its words each query shares with a text."""
        lists = [self.by_word[w] for w in words_of(text) if w in self.by_word]
        return np.bincount(np.concatenate(lists), minlength=len(self.rows)) if lists else np.zeros(len(self.rows), np.int64)


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e4 + 0.5) / 1e4


def best_chunks(asked: Postings, batches: Iterator[pa.RecordBatch], least: float, keep: int) -> Iterator[tuple]:
    """(query, chunk, score, position unknown): the ``keep`` best of each query among the chunks of one task.

    Block by block: impact lists of the marks give each pair's mark score; what a body can add is 1.5 at most. Chunks are
    gone through from the largest mark score down, and a body is read only if for some query the bound reaches that
    query's running threshold, the score of its ``keep``-th best so far (``least`` to begin with); as the threshold rises,
    ever fewer are. Pairs under it are never scored. The bound loses nothing: equal scores go to the smaller chunk_id.
    """
    heaps: list[list[tuple]] = [[] for _ in asked.rows]
    floor = np.full(len(asked.rows), float(least))
    size = max(1, CELLS // max(1, len(asked.rows)))
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            rows = [None if j == 5 else c.to_pylist() for j, c in enumerate(part.columns)]  # a body becomes Python's when it is read
            marks = np.zeros((len(rows[0]), len(asked.rows)))
            lifted: dict[int, np.ndarray] = {}
            for i, (chunk, subject, unit, keywords, tags, boosted) in enumerate(zip(*(rows[j] for j in (0, 1, 2, 3, 4, 6)), strict=True)):
                for kind, listed in (("keyword", keywords), ("tag", tags), ("unit", [unit])):
                    for mark in listed or []:
                        if mark is not None:
                            hit, points = asked.impacts(kind, mark)
                            marks[i, hit] += points
                if boosted:
                    lifted[i] = np.unique([asked.number[q] for q in boosted if q in asked.number]).astype(np.int64)
                    marks[i, lifted[i]] += 0.5
                marks[i, asked.barred(subject)] = -np.inf
            for i in np.argsort(-marks.max(axis=1, initial=-np.inf), kind="stable").tolist():
                near = np.flatnonzero(marks[i] + 1.5 + 1e-4 >= floor)
                if not len(near):
                    continue
                points = marks[i].copy()
                if i in lifted:
                    points[lifted[i]] -= 0.5
                score = rounded(points[near] + 1.5 * np.minimum(asked.shared(part.column(5)[i].as_py())[near] / asked.n[near], 1.0))
                if i in lifted:
                    score = rounded(score + 0.5 * np.isin(near, lifted[i]))
                for q, s in zip(near[score >= floor[near]].tolist(), score[score >= floor[near]].tolist(), strict=True):
                    found = sorted([*heaps[q], (-s, rows[0][i])])[:keep]
                    heaps[q] = found
                    if len(found) == keep:
                        floor[q] = -found[-1][0]
    for q, found in enumerate(heaps):
        for s, chunk in found:
            yield asked.rows[q][0], chunk, -s


def retrieve(queries: DataFrame, chunks: DataFrame, boosted: DataFrame | None = None, least: float = 0.5, keep: int = 3) -> DataFrame:
    """query_id, chunk_id, score, position: the ``keep`` best chunks of each query that score ``least`` or more, ties to the
    smaller chunk_id.

    queries: query_id, text, subject (null: any), unit (null: none). chunks: chunk_id (unique), subject, unit, keywords,
    tags, text. Only chunks of the query's subject or of ``general`` count. boosted: query_id, chunk_id (distinct): half a
    point more. A query without a word finds nothing. A keyword that the query contains counts 2, one that shares a word 1,
    and a repeated one repeatedly; a tag that shares a word 0.8; an equal unit 1, one that contains the other 0.5; the body
    1.5 times the share of the query's words that it holds.

    Queries are held by all tasks, in passes of a checked size (``passes``), each one read of the chunks, where they lie: no
    text is shuffled, and a task hands on ``keep`` rows a query.
    """
    types = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    schema = StructType.fromDDL(f"query_id {types[0]}, chunk_id {types[1]}, score double")
    arrow = to_arrow_schema(schema)
    spark = queries.sparkSession
    rows = chunks.select("chunk_id", "subject", "unit", "keywords", "tags", "text")
    if boosted is not None:
        lifts = boosted.groupBy("chunk_id").agg(F.collect_set("query_id").alias("lifts"))
        rows = rows.join(lifts, "chunk_id", "left")
    else:
        rows = rows.withColumn("lifts", F.array().cast(f"array<{types[0]}>"))
    found = spark.createDataFrame([], schema)
    for part in passes(queries.select("query_id", "text", "subject", "unit").where(F.col("text").isNotNull())):
        held = spark.sparkContext.broadcast([tuple(r) for r in part])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = list(best_chunks(Postings(held.value), batches, least, keep))
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "chunk_id", "score"), r, strict=True)) for r in best], arrow)

        found = found.unionByName(rows.mapInArrow(run, schema))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= keep)


def matched_terms(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """query_id, term_id (distinct): the terms of which a query holds a form. forms: term_id, form."""
    pairs = substring_pairs(forms.select(F.col("form").alias("needle")), queries.select(F.col("query_id").alias("text_id"), "text"), bounded=True)
    return pairs.select(F.col("text_id").alias("query_id"), F.col("needle").alias("form")).join(forms, "form").select("query_id", "term_id").distinct()


def expansions(queries: DataFrame, forms: DataFrame, confusable: DataFrame) -> DataFrame:
    """query_id, text with the forms of the terms that it holds, and of those confusable with them, behind it in order.

    forms: term_id, form. confusable: term_id, other (term_id)."""
    terms = matched_terms(queries, forms)
    both = terms.union(terms.join(confusable, "term_id").select("query_id", F.col("other").alias("term_id"))).distinct()
    more = both.join(forms, "term_id").groupBy("query_id").agg(F.collect_set("form").alias("forms"))
    none = F.array().cast("array<string>")
    rows = queries.join(more, "query_id", "left").withColumn("forms", F.coalesce("forms", none))
    return rows.withColumn("text", F.when(F.size("forms") > 0, expanded(F.col("text"), F.col("forms"))).otherwise(F.col("text"))).drop("forms")


def expanded(query: Column, forms: Column) -> Column:
    """A query with its expansions behind it, in order."""
    return F.concat_ws(" ", query, F.array_join(F.array_sort(F.array_distinct(forms)), " "))


def context(rows: DataFrame, by: list[str], order: list[str], text: Column) -> DataFrame:
    """by, context: the texts of a group in order, joined by blank lines."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))
