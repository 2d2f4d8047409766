"""Numbers as Column to Column helpers: nearest choices, money, taxes, schedules, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate tax brackets (from, to, rate).
BRACKETS = [(0, 2e8, 0.09), (2e8, 2e10, 0.19), (2e10, 3e11, 0.21), (3e11, None, 0.24)]


def number(text: Column) -> Column:
    """The number in a text, commas left out; null without one."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(",")), "([+-]?[0-9]+(?:\\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def nearest_choice(target: Column, values: Column) -> Column:
    """The 0-based place of the value nearest to the target, the first on ties; null values do not count."""
    distances = F.filter(F.transform(values, lambda v, i: F.struct(F.abs(v - target).alias("d"), i.alias("i"))), lambda s: s["d"].isNotNull())
    return F.array_min(distances)["i"]


def money(text: Column) -> Column:
    """All amounts of a text in order: ₩ before, or 원 or 억원 (a hundred million) behind; bare numbers do not count."""
    found = F.regexp_extract_all(text, F.lit("(₩\\s*[0-9][0-9,]*(?:\\.[0-9]+)?|[0-9][0-9,]*(?:\\.[0-9]+)?\\s*억\\s*원|[0-9][0-9,]*(?:\\.[0-9]+)?\\s*원)"), F.lit(1))
    return F.transform(found, lambda m: number(m) * F.when(F.contains(m, F.lit("억")), 1e8).otherwise(1.0))


def progressive_tax(base: Column) -> Column:
    parts = [F.greatest((F.least(base, F.lit(float(hi))) if hi else base) - lo, F.lit(0.0)) * rate for lo, hi, rate in BRACKETS]
    return sum(parts[1:], parts[0])


def npv(outlay: Column, flows: Column, rate: Column) -> Column:
    return F.aggregate(F.transform(flows, lambda x, i: x / F.pow(1 + rate, (i + 1).cast("double"))), -outlay, lambda s, x: s + x)


def schedule(book: Column, face: Column, coupon: Column, effective: Column, periods: Column, digits: int = 2) -> Column:
    """Effective-interest amortization: (period, interest, cash, change, book) of each period; every step is rounded, and
    starts from the rounded book value before it."""
    kind = "array<struct<period:int,interest:double,cash:double,change:double,book:double>>"
    cash = F.round(face * coupon, digits)

    def step(state: Column, k: Column) -> Column:
        interest = F.round(state["book"] * effective, digits)
        change = F.round(interest - cash, digits)
        after = F.round(state["book"] + change, digits)
        row = F.struct(k.alias("period"), interest.alias("interest"), cash.alias("cash"), change.alias("change"), after.alias("book"))
        return F.struct(after.alias("book"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct(book.cast("double").alias("book"), F.array().cast(kind).alias("rows"))
    return F.aggregate(F.sequence(F.lit(1), periods.cast("int")), start, step, lambda s: s["rows"])


def calculate(op: Column, operands: Column) -> Column:
    """add, sub, mul, div, pow, sum, avg over a list; null for another name or a divisor of zero."""
    first = F.try_element_at(operands, F.lit(1))
    rest = F.slice(operands, F.lit(2), F.greatest(F.size(operands) - 1, F.lit(0)))
    total = F.aggregate(operands, F.lit(0.0), lambda s, x: s + x)
    return (
        F.when(op.isin("add", "sum"), total)
        .when(op == "sub", F.aggregate(rest, first, lambda s, x: s - x))
        .when(op == "mul", F.aggregate(operands, F.lit(1.0), lambda s, x: s * x))
        .when(op == "div", F.aggregate(rest, first, lambda s, x: F.try_divide(s, x)))
        .when(op == "pow", F.aggregate(rest, first, lambda s, x: F.pow(s, x)))
        .when(op == "avg", F.try_divide(total, F.size(operands)))
    )


def whole_units(start: Column, end: Column, unit: str) -> Column:
    """Whole days, months or years from start to end; null if the end comes first."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")
    out = {"days": F.datediff(end, start), "months": months, "years": F.floor(months / 12).cast("int")}[unit]
    return F.when(end >= start, out)
