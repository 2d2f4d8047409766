"""Plans for the generation of questions, and the counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# How hard an item may be.
DIFFICULTIES = ("easy", "mid", "hard")
KIND = "array<struct<item:string,subject:string,unit:string,difficulty:string,count:bigint,error:string>>"


def items_of(spec: Column, subjects: list[str]) -> Column:
    """The items of a plan ``subject:unit:difficulty[:count],...``: array of (item, subject, unit, difficulty, count, error).

    Blanks around items and fields do not count, nor do empty items; a missing count is 1. ``error`` is null or the first of
    format (not three or four fields), subject, unit (empty), difficulty, count (no integer), count_below_one; a plan
    without an item, or a null one, is one item with the error empty.
    """
    items = F.filter(F.transform(F.split(spec, ","), lambda e: F.trim(e)), lambda e: e != "")

    def told(item: Column) -> Column:
        parts = F.transform(F.split(item, ":"), lambda p: F.trim(p))

        def field(k: int) -> Column:
            return F.get(parts, F.lit(k))

        number = F.when(field(3).rlike("^[+-]?[0-9]+$"), field(3).try_cast("long"))
        count = F.when(F.size(parts) == 3, F.lit(1).cast("long")).otherwise(number)
        error = (
            F.when(~F.size(parts).isin(3, 4), "format")
            .when(~field(0).isin(subjects), "subject")
            .when(field(1) == "", "unit")
            .when(~field(2).isin(*DIFFICULTIES), "difficulty")
            .when(count.isNull(), "count")
            .when(count < 1, "count_below_one")
        )
        return F.struct(item.alias("item"), field(0).alias("subject"), field(1).alias("unit"), field(2).alias("difficulty"), F.when(error.isNull(), count).alias("count"), error.alias("error"))

    none = F.lit(None).cast("string")
    empty = F.array(F.struct(F.lit("").alias("item"), none.alias("subject"), none.alias("unit"), none.alias("difficulty"), F.lit(None).cast("long").alias("count"), F.lit("empty").alias("error")))
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) == 0, empty).otherwise(F.transform(items, told)).cast(KIND)


def written_with_counts(rows: DataFrame, path: str, keep: Column, counts: dict[str, Column]) -> dict[str, int]:
    """Writes the rows that ``keep`` says to ``path``, and gives how many of all rows met each condition of ``counts``: they
    are counted as they are written, so there is no second pass over the rows (or calls of a model)."""
    seen = Observation()
    rows.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items())).where(keep).write.parquet(path)
    return seen.get


def tutorial_of(subject: Column, unit: Column, ladder: list[tuple[str, tuple[str, ...], str]]) -> Column:
    """The tutorial for a subject and unit: the first of ``ladder`` (subject, units: empty for all, tutorial); else empty."""
    out = F.lit("")
    for own, units, tutorial in reversed(ladder):
        out = F.when((subject == own) & (F.coalesce(unit, F.lit("")).isin(*units) if units else F.lit(True)), tutorial).otherwise(out)
    return out
