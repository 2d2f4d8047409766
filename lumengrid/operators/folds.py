"""Sequential computations inside a row, as folds over arrays: inventories, statements, numbering, rates, traps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumengrid.functions.numbers import npv


def moving_average(moves: Column) -> Column:
    """Units, value and cost of sales after moves (struct of kind, qty, price) in order: buys at their price, sales at the
    average so far. Null from the first sale of more than there is."""

    def step(s: Column, m: Column) -> Column:
        cost = F.try_divide(s["value"], s["units"]) * m["qty"]
        buy = m["kind"] == "buy"
        short = ~buy & (m["qty"] > s["units"])
        return F.when(s.isNull() | short, F.lit(None)).otherwise(
            F.struct(
                F.when(buy, s["units"] + m["qty"]).otherwise(s["units"] - m["qty"]).alias("units"),
                F.when(buy, s["value"] + m["qty"] * m["price"]).otherwise(s["value"] - cost).alias("value"),
                F.when(buy, s["sold"]).otherwise(s["sold"] + cost).alias("sold"),
            )
        )

    return F.aggregate(moves, F.struct(F.lit(0.0).alias("units"), F.lit(0.0).alias("value"), F.lit(0.0).alias("sold")), step)


def signed_total(start: Column, items: Column, signs: dict[str, int]) -> Column:
    """start with items (struct of label, amount) added or taken away by the first sign whose name the label holds; null if
    a label holds none."""

    def sign(label: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, s in reversed(signs.items()):
            out = F.when(F.contains(label, F.lit(name)), F.lit(float(s))).otherwise(out)
        return out

    return F.aggregate(items, start, lambda t, i: t + sign(i["label"]) * i["amount"])


def accepted_numbers(numbers: Column, gap: int = 3) -> Column:
    """The numbers that continue a numbering from 1: the one expected, or one up to ``gap`` after it."""

    def step(s: Column, n: Column) -> Column:
        fits = (n >= s["next"]) & (n <= s["next"] + gap)
        return F.struct(F.when(fits, n + 1).otherwise(s["next"]).alias("next"), F.when(fits, F.concat(s["kept"], F.array(n))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(numbers, F.struct(F.lit(1).cast("long").alias("next"), F.array().cast("array<bigint>").alias("kept")), step, lambda s: s["kept"])


def closest_rate(outlay: Column, flows: Column, rates: Column) -> Column:
    """The 0-based place of the rate whose net present value lies nearest to 0, the first on ties."""
    return F.array_min(F.transform(rates, lambda r, i: F.struct(F.abs(npv(outlay, flows, r)).alias("d"), i.alias("i"))))["i"]


def income_with_grossup(interest: Column, foreign: Column, eligible: Column, cap: float = 2e7, rate: float = 0.10) -> Column:
    """Financial income with dividends grossed up: what is not eligible fills the cap first, and the eligible rest counts."""
    plain = interest + foreign
    base = F.when(plain + eligible > cap, F.greatest(F.lit(0.0), eligible - F.greatest(F.lit(0.0), cap - plain))).otherwise(0.0)
    return plain + eligible + base * rate


def acquisition_with_surtaxes(base: Column, rate: Column) -> Column:
    """Acquisition tax with education tax (a fifth of the rate over 2 %) and farming tax (a tenth of 2 %)."""
    return base * rate + base * (rate - 0.02) * 0.20 + base * 0.02 * 0.10


def trap_hit(traps: Column, chosen: Column, correct: Column, least: int = 4) -> Column:
    """Whether a wrong choice holds a part (``least`` characters or more) of a trap; null without traps, false if right."""
    parts = F.filter(F.flatten(F.transform(traps, lambda t: F.split(t, "[\\s,·]+"))), lambda p: F.length(p) >= least)
    return F.when(F.coalesce(F.size(traps), F.lit(0)) <= 0, F.lit(None)).when(correct, F.lit(False)).otherwise(F.exists(parts, lambda p: F.contains(chosen, p)))


def search_key(text: Column) -> Column:
    """A text for loose comparison: lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z가-힣]", "")


def loose_match(source: Column, labels: Column) -> Column:
    """16 for a label that the source holds, else 5 for each of its parts of three letters or more that it holds."""

    def one(label: Column) -> Column:
        key = search_key(label)
        parts = F.filter(F.transform(F.split(label, "[:\\s,/_-]+"), search_key), lambda p: (F.length(p) >= 3) & F.contains(source, p))
        return F.when(key == "", 0).when(F.contains(source, key), 16).otherwise(5 * F.size(parts))

    return F.aggregate(labels, F.lit(0), lambda s, x: s + one(x))


def equal_split(total: Column, n: int) -> list[Column]:
    """A total in n equal parts of two decimals; what rounding leaves goes to the first."""
    each = F.when(total > 0, F.round(total / n, 2)).otherwise(0.0)
    drift = F.round(total - each * n, 2)
    return [F.round(each + F.when(F.abs(drift) >= 0.01, drift).otherwise(0.0), 2)] + [each] * (n - 1)


def streamed(rows: DataFrame, key: str, order: list, columns: list[str], schema: str, start: Callable, step: Callable, finish: Callable) -> DataFrame:
    """One row a key: ``finish(key, state)`` after ``state = step(state, *columns)`` over the key's rows in ``order``. Rows are
    shuffled by key, sorted by Spark (which spills) and read one by one, so a task holds one state, however long a key is."""
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), shape, strict=True)], schema=shape)

        for b in batches:
            for k, *values in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if now != (k,):
                    if now:
                        done.append(finish(now[0], state))
                    now, state = (k,), start()
                state = step(state, *values)
            if done:
                yield table()
                done = []
        if now:
            done = [finish(now[0], state)]
            yield table()

    return rows.repartition(key).sortWithinPartitions(key, *order).select(key, *columns).mapInArrow(run, schema)


def moving_average_step(s: tuple | None, sell: bool, qty: float, price: float) -> tuple | None:
    """(units, value, sold) after one move; None from the first sale of more than there is."""
    if s is None or sell and qty > s[0]:
        return None
    units, value, sold = s
    if not sell:
        return units + qty, value + qty * price, sold
    cost = value / units * qty if units else 0.0
    return units - qty, value - cost, sold + cost


def accepted_step(s: tuple[int, list], n: int, gap: int = 3) -> tuple[int, list]:
    """(next number, numbers so far) after one number; see ``accepted_numbers``."""
    return (n + 1, [*s[1], n]) if s[0] <= n <= s[0] + gap else s
