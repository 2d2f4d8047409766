"""Exam papers: words on a page to columns of text, texts to questions, answer tables to keys. Reading a PDF itself stays
outside; these start from the words, cells and lines that a reader gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.functions.text import let

# The signs of choices; the share of a page's width in which its columns part, and how close the places lie
# that are tried; what of a page is header and footer; how a shared block is announced, a note without news, a line of noise.
CHOICES = "①②③④⑤"
FROM, TO, STEP = 0.42, 0.58, 2
HEADER, FOOTER = 100, 60
SHARED = f"※[^\\n{CHOICES}]{{0,60}}?([0-9]{{1,2}})번과\\s*([0-9]{{1,2}})번에\\s*답하시오"
PLAIN_NOTE = "고르시오"
NOISE = "^\\s*([0-9]+/[0-9]+|[0-9]{1,3}|제[0-9]교시|\\(계속\\)|[①②]형|책형|-끝-)\\s*$"
START = "^\\s*([0-9]{1,2})\\.(?![0-9])"


def column_splits(words: DataFrame) -> DataFrame:
    """doc, page, split: the place in the middle of a page that the fewest words cross; of equal ones the nearest to the
    center, then the left one.

    words: doc, page, width, x0, x1. A sweep: a word adds one crossing at the first place tried right of its left edge and
    takes it back at the first one not left of its right edge. Such steps are summed by place before anything is shuffled,
    so a page is as many rows as it has places, whatever the number of its words.
    """
    first, last = F.floor(F.col("width") * FROM), F.floor(F.col("width") * TO)
    places = F.ceil((last - first) / STEP).cast("int")

    def beyond(x: Column, strict: bool) -> Column:
        """The number of the first place > x (or >= x)."""
        steps = (x - first) / STEP
        return F.greatest(F.floor(steps) + 1 if strict else F.ceil(steps), F.lit(0)).cast("int")

    marked = words.select("doc", "page", "width", first.alias("first"), places.alias("places"), beyond(F.col("x0"), True).alias("a"), beyond(F.col("x1"), False).alias("z"))
    steps = F.array(F.struct(F.least("a", "places").alias("at"), F.lit(1).alias("by")), F.struct(F.least(F.greatest("a", "z"), "places").alias("at"), F.lit(-1).alias("by")))
    sums = marked.select("doc", "page", "width", "first", "places", F.inline(steps)).groupBy("doc", "page", "width", "first", "places", "at").agg(F.sum("by").alias("by"))
    pages = sums.groupBy("doc", "page", "width", "first", "places").agg(F.array_sort(F.collect_list(F.struct("at", "by"))).alias("steps"))
    none = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("now"), F.lit(None).cast("struct<crossings:bigint,off:double,x:double>").alias("best"))
    center = F.floor((F.col("width") / 2 - F.col("first")) / STEP).cast("int")

    def step(state: Column, s: Column) -> Column:
        """Between two steps the crossings stay, so of those places the ones beside the center are enough."""

        def here(i: Column) -> Column:
            x = (F.col("first") + F.greatest(state["at"], F.least(i, s["at"] - 1)) * STEP).cast("double")
            return F.struct(state["now"].alias("crossings"), F.abs(x - F.col("width") / 2).alias("off"), x.alias("x"))

        best = F.when(s["at"] > state["at"], F.least(state["best"], here(center), here(center + 1))).otherwise(state["best"])
        return F.struct(s["at"].alias("at"), (state["now"] + s["by"]).alias("now"), best.alias("best"))

    last = F.array(F.struct(F.col("places").alias("at"), F.lit(0).cast("long").alias("by")))
    found = F.when(F.col("places") > 0, F.aggregate(F.concat("steps", last), none, step, lambda s: s["best"]["x"]))
    return pages.select("doc", "page", F.coalesce(found, F.col("width") / 2).alias("split"))


def page_columns(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc, page, side (0 left, 1 right), text: the lines of each column of each page, without header, footer and noise lines.

    words: doc, page, width, height, x0, x1, top, bottom, text (one row a word). Words count where they lie wholly inside a
    column's box. Lines are islands of words whose tops, in order, are no more than ``tolerance`` apart, so a slanted line
    stays one line; words stand in a line from left to right. A column without such lines has no row. Pages are hashed for
    the join (a row each), so words are sorted once, for the lines.
    """
    low = F.least(F.lit(float(HEADER)), F.col("height") / 4)
    high = F.greatest(F.col("height") - FOOTER, F.col("height") * 0.75)
    placed = words.join(column_splits(words).hint("shuffle_hash"), ["doc", "page"]).where((F.col("top") >= low) & (F.col("bottom") <= high))
    side = F.when(F.col("x1") <= F.col("split"), 0).when((F.col("x0") >= F.col("split")) & (F.col("x1") <= F.col("width")), 1)
    own = W.partitionBy("doc", "page", "side").orderBy("top", "x0", "text")
    gap = F.coalesce(F.col("top") - F.lag("top").over(own) > tolerance, F.lit(True)).cast("int")
    lines = placed.withColumn("side", side).where("side IS NOT NULL").withColumn("gap", gap).withColumn("line", F.sum("gap").over(own.rowsBetween(W.unboundedPreceding, 0)))
    in_line = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"])
    each = lines.groupBy("doc", "page", "side", "line").agg(F.array_join(in_line, " ").alias("text")).where(~F.col("text").rlike(NOISE))
    in_column = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda t: t["text"])
    return each.groupBy("doc", "page", "side").agg(F.array_join(in_column, "\n").alias("text"))


def _pieces(text: Column) -> Column:
    """The text cut before every head of a shared block and every line that begins like a question; with what each one is."""
    parts = F.split(text, f"(?m)(?=^[ \\t]*[0-9]{{1,2}}\\.(?![0-9]))|(?={SHARED})")

    def told(p: Column, i: Column) -> Column:
        def number(pattern: str, group: int) -> Column:
            return F.nullif(F.regexp_extract(p, pattern, group), F.lit("")).cast("int")

        head = p.rlike("^" + SHARED)
        return F.struct(i.alias("at"), p.alias("text"), number("^" + SHARED, 1).alias("a"), number("^" + SHARED, 2).alias("b"), F.when(~head, number(START, 1)).alias("number"))

    return F.transform(parts, told)


def _blocks(pieces: Column) -> Column:
    """Shared blocks (from, to, a, b): from a head up to the next start of its first question; without one, the head alone.
    A head inside a block is part of it."""
    heads = F.filter(pieces, lambda p: p["a"].isNotNull())
    kind = "array<struct<from:int,to:int,a:int,b:int>>"

    def step(state: Column, h: Column) -> Column:
        end = F.array_min(F.transform(F.filter(pieces, lambda p: (p["at"] > h["at"]) & (p["number"] == h["a"])), lambda p: p["at"]))
        block = F.struct(h["at"].alias("from"), end.alias("to"), h["a"].alias("a"), h["b"].alias("b"))
        clear = F.coalesce(F.try_element_at(state, F.lit(-1))["to"] <= h["at"], F.lit(True))
        return F.when(clear, F.concat(state, F.array(block))).otherwise(state)

    return F.aggregate(heads, F.array().cast(kind), step)


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def _between(pieces: Column, a: Column, z: Column) -> Column:
    return F.array_join(F.transform(F.slice(pieces, a + 1, F.greatest(z - a, F.lit(0))), lambda p: p["text"]), "")


def _outside(pieces: Column, blocks: Column) -> Column:
    """The pieces without shared blocks: text and number (null: starts no question). A head without an end loses its own
    words, and what follows them stays."""

    def left(p: Column) -> Column:
        own = F.filter(blocks, lambda b: (p["at"] >= b["from"]) & (p["at"] < F.coalesce(b["to"], b["from"] + 1)))
        open_ = F.coalesce(F.try_element_at(own, F.lit(1))["to"].isNull(), F.lit(True))
        text = F.when(F.size(own) == 0, p["text"]).when(open_, F.regexp_replace(p["text"], "^" + SHARED, "\n")).otherwise("\n")
        return F.struct(p["at"].alias("at"), F.when(F.size(own) == 0, p["number"]).alias("number"), text.alias("text"))

    return F.transform(pieces, left)


def _starts(pieces: Column, gap: int) -> Column:
    """Where questions start: (at, number)."""
    none = F.struct(F.lit(1).alias("expect"), F.array().cast("array<struct<at:int,number:int>>").alias("kept"))

    def accept(s: Column, p: Column) -> Column:
        good = (p["number"] >= s["expect"]) & (p["number"] <= s["expect"] + gap)
        return F.when(good, F.struct((p["number"] + 1).alias("expect"), F.concat(s["kept"], F.array(F.struct(p["at"].alias("at"), p["number"].alias("number")))).alias("kept"))).otherwise(s)

    return F.aggregate(F.filter(pieces, lambda p: p["number"].isNotNull()), none, accept, lambda s: s["kept"])


def _note(preamble: Column) -> Column:
    """What stands before question 1 behind ※, but for how to mark answers; joined by slashes."""
    notes = F.filter(F.transform(F.split(preamble, "(?=※)"), _trimmed), lambda c: c.startswith("※") & ~c.contains(PLAIN_NOTE) & (F.length(c) > 5))
    return F.array_join(F.transform(notes, lambda c: _trimmed(F.ltrim(c, F.lit("※ ")))), " / ")


def _question(number: Column, body: Column, note: Column, shared: Column) -> Column:
    """number, stem, choices, split_overflow of one question's text."""

    def built(parts: Column) -> Column:
        n = F.size(parts)
        last = F.slice(parts, F.greatest(n - 4, F.lit(1)), F.lit(5))
        ordered = (n >= 6) & (F.array_join(F.transform(last, lambda p: F.left(p, F.lit(1))), "") == CHOICES)
        head = F.when(ordered, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 5, F.lit(1))), "")).otherwise(parts[0])
        before = F.concat(F.when(note != "", F.concat(F.lit("(전제: "), note, F.lit(")\n"))).otherwise(""), F.coalesce(F.concat(shared, F.lit("\n")), F.lit("")))
        picked = F.when(ordered, last).otherwise(F.slice(parts, 2, 5))
        choices = F.transform(picked, lambda c: _trimmed(F.rtrim(_trimmed(F.substring(c, F.lit(2), F.length(c))), F.lit("※"))))
        stem = F.concat(before, _trimmed(F.regexp_replace(head, START, "")))
        return F.struct(number.alias("number"), stem.alias("stem"), choices.alias("choices"), (n > 6).alias("split_overflow"))

    return let(F.split(body, f"(?=[{CHOICES}])"), built)


def questions_of(text: Column, gap: int = 3) -> Column:
    """The questions of a text: array of (number, stem, choices, split_overflow). See ``exam_questions``."""

    def said(pieces: Column, b: Column) -> Column:
        head = F.regexp_extract(F.element_at(pieces, b["from"] + 1)["text"], "^" + SHARED, 0)
        return F.struct(b["a"].alias("a"), b["b"].alias("b"), _trimmed(F.when(b["to"].isNull(), head).otherwise(_between(pieces, b["from"], b["to"]))).alias("text"))

    def told(shared: Column, left: Column, starts: Column) -> Column:
        def one(note: Column) -> Column:
            def question(start: Column, i: Column) -> Column:
                body = _between(left, start["at"], F.coalesce(F.get(starts, i + 1)["at"], F.size(left)))
                own = F.filter(shared, lambda b: (b["a"] == start["number"]) | (b["b"] == start["number"]))
                return _question(start["number"], body, note, F.try_element_at(own, F.lit(-1))["text"])

            return F.transform(starts, question)

        return let(_note(_between(left, F.lit(0), F.coalesce(F.get(starts, F.lit(0))["at"], F.lit(0)))), one)

    def with_blocks(pieces: Column) -> Column:
        def with_left(blocks: Column) -> Column:
            shared = F.transform(blocks, lambda b: said(pieces, b))
            return let(_outside(pieces, blocks), lambda left: let(shared, lambda s: let(_starts(left, gap), lambda starts: told(s, left, starts))))

        return let(_blocks(pieces), with_left)

    return let(_pieces(text), with_blocks)


def exam_questions(texts: DataFrame, gap: int = 3) -> DataFrame:
    """doc, number, stem, choices, split_overflow: the questions of each text.

    texts: doc, text. Questions begin at lines with their number, which is the one expected or up to ``gap`` above it (a
    question whose start was lost); other numbered lines belong to the stem. A shared block (``※ ... a번과 b번에 답하시오``, up to
    question a) is taken out of the text and put before the stems of a and b. A note (※) before question 1, unless it only
    tells how to mark answers, goes before all stems. Choices are the last five signs ①-⑤ if they stand in order, so a stem
    may hold such a list of its own (``split_overflow``); else the first five. A null text has no questions.
    """
    return texts.select("doc", F.inline(questions_of(F.col("text"), gap)))


def answer_index(token: Column) -> Column:
    """The 0-based choice that a sign ①-⑤ or a digit 1-5 stands for; null for all else."""
    one = F.btrim(token)
    at = F.when(F.length(one) == 1, F.greatest(F.instr(F.lit(CHOICES), one), F.instr(F.lit("12345"), one)))
    return F.when(at > 0, at - 1)


def answer_keys(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """subject, number, answer (0-based), from_line: the key of each question.

    cells: subject, page, grid, row, col, text: tables whose rows repeat (number, answer, answer of the other form); the first
    answer counts, of several the last in reading order. lines: subject, page, line, text: where no cell gives a number its
    answer, the first line that says ``number answer answer`` does. Rows without a subject are left out.
    """
    row = W.partitionBy("subject", "page", "grid", "row").orderBy("col")
    asked = cells.where("subject IS NOT NULL AND pmod(col, 3) < 2")  # a third column is never an answer, nor between the two
    paired = asked.withColumn("next", F.lead(F.struct("col", "text")).over(row)).where((F.col("col") % 3 == 0) & (F.col("next.col") == F.col("col") + 1) & F.btrim("text").rlike("^[0-9]+$"))
    given = paired.select("subject", F.btrim("text").try_cast("int").alias("number"), answer_index(F.col("next.text")).alias("answer"), F.struct("page", "grid", "row", "col").alias("place"))
    first = given.where("answer IS NOT NULL AND number IS NOT NULL").groupBy("subject", "number").agg(F.max_by("answer", "place").alias("cell"))
    said = F.regexp_extract_all("text", F.lit(f"[0-9]{{1,2}}\\s+[{CHOICES}1-5]\\s+[{CHOICES}1-5]"), F.lit(0))
    found = lines.where("subject IS NOT NULL").select("subject", "page", "line", F.posexplode(said).alias("at", "said"))
    marks = found.select("subject", F.regexp_extract("said", "^[0-9]+", 0).cast("int").alias("number"), answer_index(F.regexp_extract("said", f"^[0-9]+\\s+(.)", 1)).alias("answer"), F.struct("page", "line", "at").alias("place"))
    second = marks.groupBy("subject", "number").agg(F.min_by("answer", "place").alias("line"))
    both = first.join(second, ["subject", "number"], "full")
    return both.select("subject", "number", F.coalesce("cell", "line").alias("answer"), F.col("cell").isNull().alias("from_line"))
