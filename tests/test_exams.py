"""Exam papers: columns of pages, questions of texts, keys of answer tables."""

import random
import re

from pyspark.sql import functions as F

from lumengrid.operators import exams

WORDS = "doc int, page int, width double, height double, x0 double, x1 double, top double, bottom double, text string"


def word(text, x, y, page=1, size=50.0, width=600.0):
    return (1, page, width, 800.0, float(x), float(x) + size, float(y), float(y) + 8, text)


def columns(spark, words):
    rows = spark.createDataFrame(words, WORDS).repartition(3)
    return {(r["page"], r["side"]): r["text"] for r in exams.page_columns(rows).collect()}


def test_two_columns_are_read_one_after_the_other(spark):
    left = [word(f"L{i}{j}", 20 + 60 * j, 200 + 10 * i) for i in range(3) for j in range(4)]
    right = [word(f"R{i}{j}", 320 + 60 * j, 200 + 10 * i) for i in range(3) for j in range(4)]
    extra = [word("head", 280, 20), word("foot", 280, 790), word("12", 20, 400), word("across", 240, 500, size=90)]
    got = columns(spark, left + right + extra)
    assert got == {(1, 0): "L00 L01 L02 L03\nL10 L11 L12 L13\nL20 L21 L22 L23", (1, 1): "R00 R01 R02 R03\nR10 R11 R12 R13\nR20 R21 R22 R23"}


def test_one_column_and_slanted_lines(spark):
    one = [word(f"w{i}{j}", 30 + 70 * j, 120 + 20 * i, size=40) for i in range(2) for j in range(3)]
    slanted = [word(f"s{i}{j}", 30 + 60 * j, 120 + 20 * i + 2.5 * j, page=2) for i in range(2) for j in range(4)]
    got = columns(spark, one + slanted)
    assert got == {(1, 0): "w00 w01 w02\nw10 w11 w12", (2, 0): "s00 s01 s02 s03\ns10 s11 s12 s13"}  # 7.5 lower at its end, 2.5 a word


def test_split_is_the_place_that_fewest_words_cross(spark):
    """The sweep against counting every word at every place; the middle itself is crossed (a number hangs into it)."""
    rng = random.Random(2)
    words = []
    for page in range(30):
        width = rng.choice([600.0, 595.3, 729.0, 20.0])
        words += [(1, page, width, 800.0, x, x + rng.uniform(1, width / 3), 300.0, 308.0, "x") for x in (rng.uniform(0, width) for _ in range(rng.randint(1, 40)))]
    got = {r["page"]: r["split"] for r in exams.column_splits(spark.createDataFrame(words, WORDS)).collect()}
    for page in range(30):
        own = [w for w in words if w[1] == page]
        width = own[0][2]
        tried = range(int(width * exams.FROM), int(width * exams.TO), exams.STEP)
        best = min(((sum(w[4] < x < w[5] for w in own), abs(x - width / 2), x) for x in tried), default=(0, 0, width / 2))
        assert got[page] == best[2]


PAPER = """law
※ Assume least taxes.
※ 보기 중에서 고르시오.
1. First of all
① a ② b ③ c ④ d ⑤ e ※
2. data ① p ② q ③ r ④ s ⑤ t as given
 1.5 times
① 1 ② 2 ③ 3 ④ 4 ⑤ 5
※ 다음 자료를 이용하여 4번과 5번에 답하시오. Data X
9. of a list
4. Four
① q ② w ③ e ④ r ⑤ t
5. Five ① q ② w ③ e ④ r ⑤ t
40. noise
"""


def questions(spark, *texts):
    rows = exams.exam_questions(spark.createDataFrame(list(enumerate(texts)), "doc int, text string")).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: (r["doc"], r["number"]))]


def test_questions_with_notes_blocks_and_signs_in_stems(spark):
    got = questions(spark, PAPER)
    note, block = "(전제: Assume least taxes.)\n", "※ 다음 자료를 이용하여 4번과 5번에 답하시오. Data X\n9. of a list\n"
    assert got == [
        (1, note + "First of all", list("abcde"), False),
        (2, note + "data ① p ② q ③ r ④ s ⑤ t as given\n 1.5 times", list("12345"), True),
        (4, note + block + "Four", list("qwert"), False),  # 3 is lost: a gap of up to three is taken
        (5, note + block + "Five", [*"qwer", "t\n40. noise"], False),
    ]


def test_texts_without_questions_and_odd_ones(spark):
    assert questions(spark, None, "", "no question ① a", "7. too far ahead ① a") == []
    assert questions(spark, "1. only a stem") == [(1, "only a stem", [], False)]
    assert questions(spark, "1. x ① a ② b ③ c ④ d ⑤ e ① f") == [(1, "x", list("abcde"), True)]  # the last five are out of order
    head = "※ 자료로 8번과 9번에 답하시오"  # its first question never comes: only the head goes
    assert questions(spark, f"1. x ① a ② b ③ c ④ d ⑤ e\n{head} rest\n2. y") == [(1, "x", [*"abcd", "e\n\n rest"], False), (2, "y", [], False)]


def test_a_head_inside_a_block_is_part_of_it(spark):
    text = "1. x\n※ 자료로 2번과 3번에 답하시오 A\n※ 자료로 3번과 4번에 답하시오 B\n2. y\n3. z\n4. w"
    block = "※ 자료로 2번과 3번에 답하시오 A\n※ 자료로 3번과 4번에 답하시오 B\n"
    assert [q[1] for q in questions(spark, text)] == ["x", block + "y", block + "z", "w"]


def test_long_papers_stay_linear_enough(spark):
    text = "\n".join(f"{k % 90 + 1}. word ① a ② b ③ c ④ d ⑤ e" for k in range(3000))
    assert len(questions(spark, text)) == 90


CELLS, LINES = "subject string, page int, grid int, row int, col int, text string", "subject string, page int, line int, text string"


def test_keys_from_cells_then_from_lines(spark):
    grids = [("tax", 1, 0, 0, ["1", "①", "②", "21", "9", "3"]), ("tax", 2, 0, 0, ["1", "⑤", "②", "", "", ""]), ("tax", 2, 1, 0, ["x", "①", "①", "7", " 3 ", None]), (None, 1, 0, 0, ["2", "①", "①"])]
    cells = spark.createDataFrame([(s, p, g, r, c, t) for s, p, g, r, ts in grids for c, t in enumerate(ts)], CELLS)
    lines = spark.createDataFrame([("tax", 1, 0, "1 ② ② 21 ③ ③"), ("tax", 2, 0, "21 ④ ④  3 5 5, 8 6 1"), (None, 1, 0, "9 ① ①")], LINES)
    got = {(r["subject"], r["number"]): (r["answer"], r["from_line"]) for r in exams.answer_keys(cells, lines).collect()}
    # of two cells the last in reading order; lines fill what no cell gives, the first of them
    assert got == {("tax", 1): (4, False), ("tax", 7): (2, False), ("tax", 21): (2, True), ("tax", 3): (4, True)}
    assert exams.answer_keys(cells.limit(0), lines.limit(0)).count() == 0


def test_answer_signs(spark):
    rows = spark.createDataFrame([(t,) for t in ["①", "5", " ③ ", "6", "0", "", None, "12", "①②", "x"]], "t string")
    assert [r[0] for r in rows.select(exams.answer_index(F.col("t"))).collect()] == [0, 4, 2, None, None, None, None, None, None, None]
    assert re.match("[①-⑤]", exams.CHOICES)
