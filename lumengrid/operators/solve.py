"""Formula rules as Column expressions: guards and labelled values from a question's text, a formula, the nearest choice.

A rule is a row of RULES: its id, the words that its question must hold, the labels of its values (each the first number
within 120 characters after the label), a formula over them, and its confidence. A rule abstains (null) where a value is
missing or the formula is undefined. ``solve`` tries the rules in order and takes the first that does not abstain. All of
them stand inside one lambda over the text, which Spark evaluates as it is: a rule whose guards fail costs only its guards,
and no generated method grows with the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions.numbers import nearest_choice, number, progressive_tax
from lumengrid.operators.folds import acquisition_with_surtaxes, income_with_grossup


@dataclass(frozen=True)
class Rule:
    rule_id: str
    guards: tuple[str, ...]
    labels: tuple[str, ...]
    formula: Callable[..., Column]
    confidence: float


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def gordon(eps: Column, payout: Column, k: Column, roe: Column) -> Column:
    g = (1 - payout) * roe
    return F.when(k > g, _ratio(eps * payout, k - g))


def two_assets_deviation(s1: Column, s2: Column, rho: Column) -> Column:
    return F.sqrt(0.25 * s1 * s1 + 0.25 * s2 * s2 + 0.5 * rho * s1 * s2)


def entertainment_excess(booked: Column, base: Column, sales: Column) -> Column:
    tiers = 0.003 * F.least(sales, F.lit(1e10)) + 0.002 * F.greatest(F.least(sales, F.lit(5e10)) - 1e10, F.lit(0.0)) + 0.0003 * F.greatest(sales - 5e10, F.lit(0.0))
    return F.greatest(booked - base - tiers, F.lit(0.0))


# Order decides where several rules could answer.
RULES = [
    Rule("accounting_effective_interest", ("effective interest",), ("book value", "effective rate"), lambda b, r: b * r, 0.93),
    Rule("finance_gordon_growth", ("growth model",), ("eps", "payout", "required return", "roe"), gordon, 0.91),
    Rule("accounting_revaluation_loss", ("revaluation",), ("decrease", "surplus"), lambda d, s: F.greatest(d - s, F.lit(0.0)), 0.90),
    Rule("tax_corporate_progressive_rate", ("corporate tax",), ("tax base",), progressive_tax, 0.88),
    Rule("accounting_straight_line_depreciation", ("straight-line",), ("cost", "residual", "life"), lambda c, r, n: _ratio(c - r, n), 0.93),
    Rule("cost_bep_sales", ("break-even sales",), ("fixed cost", "contribution ratio"), _ratio, 0.92),
    Rule("accounting_cogs", ("cost of goods sold",), ("opening", "purchases", "closing"), lambda o, p, c: o + p - c, 0.90),
    Rule("accounting_eps", ("earnings per share",), ("net income", "preferred", "shares"), lambda n, p, s: _ratio(n - p, s), 0.90),
    Rule("cost_overhead_application_variance", ("overhead variance",), ("actual overhead", "actual hours", "budget overhead", "budget hours"), lambda a, h, b, n: a - _ratio(h * b, n), 0.90),
    Rule("cost_margin_of_safety_ratio", ("margin of safety",), ("sales", "bep"), lambda s, b: _ratio(s - b, s), 0.90),
    Rule("cost_dol_profit_change", ("operating leverage",), ("contribution", "operating income", "growth"), lambda c, o, g: _ratio(c * g, o), 0.90),
    Rule("cost_special_order_profit", ("special order",), ("price", "variable cost", "quantity"), lambda p, v, q: F.when(p > v, (p - v) * q), 0.90),
    Rule("finance_growing_perpetuity_pv", ("growing perpetuity",), ("payment", "rate", "growth"), lambda p, r, g: F.when(r > g, _ratio(p, r - g)), 0.90),
    Rule("finance_perpetuity_pv", ("perpetuity",), ("payment", "rate"), _ratio, 0.93),
    Rule("finance_ordinary_annuity_pv", ("annuity factor", "present value"), ("payment", "factor"), lambda p, f: p * f, 0.90),
    Rule("finance_npv_annuity_factor", ("net present value",), ("annual flow", "factor", "outlay"), lambda a, f, i: a * f - i, 0.92),
    Rule("finance_capm_required_return", ("capm",), ("risk-free", "beta", "market return"), lambda rf, b, m: rf + b * (m - rf), 0.93),
    Rule("finance_portfolio_expected_return", ("portfolio return",), ("weight one", "return one", "weight two", "return two"), lambda w1, r1, w2, r2: F.when(F.abs(w1 + w2 - 1) < 1e-9, w1 * r1 + w2 * r2), 0.92),
    Rule("finance_portfolio_std_dev", ("portfolio deviation",), ("deviation one", "deviation two", "correlation"), two_assets_deviation, 0.90),
    Rule("finance_wacc", ("wacc",), ("equity share", "equity cost", "debt share", "debt cost", "tax rate"), lambda e, re, d, rd, t: e * re + d * rd * (1 - t), 0.93),
    Rule("finance_put_call_parity", ("put-call",), ("call", "spot", "strike", "rate"), lambda c, s, k, r: c - s + _ratio(k, 1 + r), 0.92),
    Rule("accounting_impairment_loss", ("impairment",), ("carrying", "value in use", "fair value"), lambda c, u, f: F.greatest(c - F.greatest(u, f), F.lit(0.0)), 0.90),
    Rule("accounting_transaction_price_allocation", ("transaction price",), ("contract", "own price", "sum of prices"), lambda c, p, s: _ratio(c * p, s), 0.88),
    Rule("tax_entertainment_expense_limit", ("entertainment",), ("booked", "base limit", "revenue"), entertainment_excess, 0.90),
    Rule("tax_vat_output_deemed_supply", ("deemed supply",), ("domestic", "gifts"), lambda d, g: 0.1 * (d + g), 0.88),
    Rule("tax_vat_payable", ("vat payable",), ("output tax", "bad debt", "input tax"), lambda o, b, i: o - b * 10 / 110 - i, 0.85),
    Rule("tax_vat_common_input_apportionment", ("common input",), ("common tax", "taxable", "exempt"), lambda c, t, e: _ratio(c * t, t + e), 0.86),
    Rule("tax_acquisition_base_rate", ("acquisition tax",), ("price", "broker fee", "rate"), lambda p, b, r: (p + b) * r, 0.90),
    Rule("cost_manufacturing_flow", ("manufacturing flow",), ("opening work", "manufacturing cost", "closing work", "opening goods", "closing goods"), lambda ow, m, cw, og, cg: ow + m - cw + og - cg, 0.92),
    Rule("cost_bep_units_and_safety_sales", ("safety sales",), ("fixed cost", "contribution ratio", "safety margin"), lambda f, c, m: _ratio(_ratio(f, c), 1 - m), 0.88),
    Rule("tax_financial_income_grossup", ("gross-up",), ("interest", "foreign dividends", "domestic dividends"), income_with_grossup, 0.90),
    Rule("tax_acquisition_with_surtaxes", ("surtaxes",), ("tax base", "standard rate"), lambda b, r: F.when(F.abs(r - 0.04) < 1e-9, acquisition_with_surtaxes(b, r)), 0.88),
    Rule("economics_quantity_theory_inflation", ("quantity theory",), ("money growth", "output growth"), lambda m, y: m - y, 0.90),
    Rule("economics_uip_return_gap", ("interest parity",), ("home rate", "foreign rate", "depreciation"), lambda k, u, x: k - (u + x), 0.86),
    Rule("management_eoq", ("order quantity",), ("demand", "order cost", "holding cost"), lambda d, s, h: F.when(h > 0, F.sqrt(_ratio(2 * d * s, h))), 0.93),
]


def value_after(text: Column, label: str, reach: int = 120) -> Column:
    """The first number within ``reach`` characters after a label; null without one. A per cent sign divides by a hundred."""
    at = F.instr(text, label)
    window = F.substring(text, at + len(label), F.lit(reach))
    percent = F.regexp_extract(F.replace(window, F.lit(",")), "^[^0-9+-]*[+-]?[0-9.]+\\s*(%?)", 1) == "%"
    return F.when(at > 0, number(window) / F.when(percent, 100.0).otherwise(1.0))


def answers(text: Column, rules: list[Rule] = RULES) -> list[tuple[Rule, Column]]:
    """Each rule's value for a text."""
    out = []
    for r in rules:
        guard = F.lit(True)
        for g in r.guards:
            guard = guard & F.contains(text, F.lit(g))
        out.append((r, F.when(guard, r.formula(*[value_after(text, label) for label in r.labels]))))
    return out


def _first(text: Column) -> Column:
    """(r, v, c) of the first rule that answers; null if none does."""
    found = [F.when(v.isNotNull(), F.struct(F.lit(r.rule_id).alias("r"), v.alias("v"), F.lit(r.confidence).alias("c"))) for r, v in answers(text)]
    return F.coalesce(*found)


def solve(questions: DataFrame, bank: DataFrame | None = None) -> DataFrame:
    """question_id, rule_id, value, choice (0-based, -1: abstains), confidence. questions: question_id, text, choices (numbers).
    ``bank`` (question_id, choice, confidence) answers where every rule abstains."""
    rows = questions.withColumn("_f", F.element_at(F.transform(F.array(F.lower("text")), _first), 1))
    rows = rows.withColumns({"rule_id": F.col("_f.r"), "value": F.col("_f.v"), "confidence": F.coalesce("_f.c", F.lit(0.0))}).drop("_f")
    rows = rows.withColumn("choice", F.coalesce(nearest_choice(F.col("value"), F.col("choices")), F.lit(-1)))
    if bank is not None:
        known = bank.select("question_id", F.col("choice").alias("_c"), F.col("confidence").alias("_p"))
        rows = rows.join(known, "question_id", "left")
        use = F.col("rule_id").isNull() & F.col("_c").isNotNull()
        rows = rows.withColumns({"choice": F.when(use, F.col("_c")).otherwise(F.col("choice")), "confidence": F.when(use, F.col("_p")).otherwise(F.col("confidence")), "rule_id": F.when(use, "known_solution_bank").otherwise(F.col("rule_id"))})
    return rows.select("question_id", F.coalesce("rule_id", F.lit("unsupported")).alias("rule_id"), "value", F.col("choice").cast("int").alias("choice"), "confidence")


def treasury_sales(cost: Column, sales: Column) -> Column:
    """Own shares bought at ``cost`` each and sold (array of struct of qty, price): book and cash of the sales, and the gain
    (loss if negative), which is capital, never income. Nothing is null that is known: no sales give zeros."""
    zero = F.struct(F.lit(0.0).alias("cash"), F.lit(0.0).alias("book"))
    sums = F.aggregate(sales, zero, lambda s, x: F.struct((s["cash"] + x["qty"] * x["price"]).alias("cash"), (s["book"] + x["qty"] * cost).alias("book")))
    return F.transform(F.array(sums), lambda s: F.struct(s["cash"].alias("cash"), s["book"].alias("book"), (s["cash"] - s["book"]).alias("gain")))[0]


def entry_choice(choices: Column, amounts: list[Column], label: Column, needs: list[str], bars: list[str] = []) -> Column:
    """The 0-based place of the first choice that names all amounts, the label and every needed word, and no barred one; -1."""

    def numbers(c: Column) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit("([0-9][0-9,]*)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))

    def fits(c: Column) -> Column:
        out = F.contains(c, label)
        for x in amounts:
            out = out & F.array_contains(numbers(c), x)
        for w in needs:
            out = out & F.contains(c, F.lit(w))
        for w in bars:
            out = out & ~F.contains(c, F.lit(w))
        return out

    places = F.transform(choices, lambda c, i: F.when(fits(c), i))
    return F.coalesce(F.array_min(F.filter(places, lambda i: i.isNotNull())), F.lit(-1))


def taxable_income(text: Column, base: str, subtract: list[str], add: list[str], barred: list[tuple[str, str]]) -> Column:
    """The number after ``base``, with what each other line names added or taken away; null if a line with an amount has no
    sign, or several amounts. A line is taken away if it holds a word of ``subtract`` (for a word of ``barred``: and not the
    other one), else added if it holds one of ``add``. Lines without an amount of three digits do not count."""
    lines = F.filter(F.split(text, "[\r\n]+"), lambda x: ~F.contains(x, F.lit(base)))

    def of(x: Column) -> Column:
        found = F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("([0-9][0-9,]{2,})"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double")))
        less = F.lit(False)
        for w in subtract:
            less = less | F.contains(x, F.lit(w))
        for w, unless in barred:
            less = less | (F.contains(x, F.lit(w)) & ~F.contains(x, F.lit(unless)))
        more = F.lit(False)
        for w in add:
            more = more | F.contains(x, F.lit(w))
        sign = F.when(less, -1.0).when(more, 1.0)
        return F.when(F.size(found) == 0, 0.0).when(F.size(found) == 1, sign * F.get(found, F.lit(0)))

    start = F.replace(F.regexp_extract(text, f"{base}[^0-9]{{0,8}}([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.aggregate(F.transform(lines, of), start, lambda s, v: s + v)
