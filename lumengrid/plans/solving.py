"""Formula queries over numbers of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions import numbers as N
from lumengrid.operators import solve
from lumengrid.plans.registry import query
from lumengrid.sources.tables import table


@query("WITH c AS (SELECT p_partkey, p_retailprice AS target, [p_size * 20.0::DOUBLE, NULL, 900.0 + p_size, 1000.0 - p_size, 950.0] AS v FROM part), e AS (SELECT p_partkey, abs(unnest(v) - target) AS d, unnest(range(5)) AS i FROM c) SELECT p_partkey, arg_min(i, (d, i))::INT AS choice FROM e WHERE d IS NOT NULL GROUP BY p_partkey")
def nearest_choice(spark, d) -> DataFrame:
    values = F.array(F.col("p_size") * 20.0, F.lit(None).cast("double"), 900.0 + F.col("p_size"), 1000.0 - F.col("p_size"), F.lit(950.0))
    return table(spark, d, "part").select("p_partkey", N.nearest_choice(F.col("p_retailprice"), values).alias("choice"))


@query("SELECT o_orderkey, 2::BIGINT AS n, (round(o_totalprice)::BIGINT + 5 * 100000000 * (1 + o_custkey % 3))::DOUBLE AS total FROM orders")
def money_parse(spark, d) -> DataFrame:
    """Amounts in a text: of the currency's own unit and of a hundred million of it."""
    won = F.round("o_totalprice").cast("long").cast("string")
    text = F.concat(F.lit("price ₩"), won, F.lit(" and 7 more, "), (5 * (1 + F.col("o_custkey") % 3)).cast("string"), F.lit("억원"))
    found = N.money(text)
    return table(spark, d, "orders").select("o_orderkey", F.size(found).cast("long").alias("n"), F.aggregate(found, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT o_orderkey, round(-o_totalprice + o_totalprice * 0.4 / (1.08::DOUBLE ^ 1) + o_totalprice * 0.5 / (1.08::DOUBLE ^ 2) + o_totalprice * 0.6 / (1.08::DOUBLE ^ 3), 2) AS npv FROM orders")
def npv(spark, d) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(N.npv(p, F.array(p * 0.4, p * 0.5, p * 0.6), F.lit(0.08)), 2).alias("npv"))


@query("WITH b AS (SELECT o_orderkey, o_totalprice * 10000 AS base FROM orders) SELECT o_orderkey, round(least(base, 2e8) * 0.09 + greatest(least(base, 2e10) - 2e8, 0) * 0.19 + greatest(least(base, 3e11) - 2e10, 0) * 0.21 + greatest(base - 3e11, 0) * 0.24)::BIGINT AS tax FROM b")
def progressive_tax(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(N.progressive_tax(F.col("o_totalprice") * 10000)).cast("long").alias("tax"))


@query(
    """WITH RECURSIVE s AS (SELECT p_partkey, 0 AS period, p_retailprice AS book, p_size FROM part
  UNION ALL SELECT p_partkey, period + 1, round(book + round(round(book * 0.0913::DOUBLE, 2) - round(1000 * p_size / 1000, 2), 2), 2), p_size FROM s WHERE period < 5) SELECT p_partkey, period, book FROM s WHERE period > 0"""
)
def amortization(spark, d) -> DataFrame:
    """Five periods of an effective-interest schedule; each step starts from the rounded one before."""
    rows = N.schedule(F.col("p_retailprice"), F.lit(1000.0), F.col("p_size") / 1000, F.lit(0.0913), F.lit(5))
    return table(spark, d, "part").select("p_partkey", F.inline(rows)).select("p_partkey", "period", "book")


@query(
    """WITH x AS (SELECT o_orderkey, DATE '1995-01-31' AS a, o_orderdate::DATE AS b FROM orders), m AS (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) - (day(b) < day(a))::INT AS m FROM x)
SELECT o_orderkey, CASE WHEN b >= a THEN b - a END::INT AS days, CASE WHEN b >= a THEN m END::INT AS months, CASE WHEN b >= a THEN m // 12 END::INT AS years FROM m"""
)
def date_diff(spark, d) -> DataFrame:
    """Whole days, months and years; null where the end comes first."""
    a, b = F.lit("1995-01-31").cast("date"), F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", *[N.whole_units(a, b, u).cast("int").alias(u) for u in ("days", "months", "years")])


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['add', 'sub', 'mul', 'div', 'avg'][1 + l_linenumber % 5] AS op, l_quantity AS a, l_linenumber::DOUBLE - 3 AS b FROM lineitem)
SELECT op, count(*) AS n, count(v) AS n_valid, round(sum(v), 2) AS total FROM (SELECT op, CASE op WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b WHEN 'div' THEN a / nullif(b, 0) ELSE (a + b) / 2 END AS v FROM x) GROUP BY op"""
)
def calculator(spark, d) -> DataFrame:
    ops = F.array(*[F.lit(o) for o in ("add", "sub", "mul", "div", "avg")])
    op = F.get(ops, F.col("l_linenumber") % 5)
    v = N.calculate(F.col("op"), F.array("l_quantity", F.col("l_linenumber").cast("double") - 3))
    rows = table(spark, d, "lineitem").withColumn("op", op).select("op", v.alias("v"))
    return rows.groupBy("op").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS running FROM orders")
def running_gain(spark, d) -> DataFrame:
    """Running sums over ordered disposals, in whole cents."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w).alias("running"))


# A part stands for a question of one rule, by its key. A value is written and computed from the rounded price (a), the size
# (b, a whole number) or b per cent (p), with a number added, (100 - b) per cent (q), or stands by itself (=).
RULE_VALUES: dict[str, tuple[list[str], str]] = {
    "accounting_effective_interest": (["a0", "p1"], "{0} * {1}"),
    "finance_gordon_growth": (["a0", "p0", "p60", "p0"], "{0} * {1} / ({2} - (1 - {1}) * {3})"),
    "accounting_revaluation_loss": (["a0", "b0"], "greatest({0} - {1}, 0)"),
    "tax_corporate_progressive_rate": (["a0"], "{0} * 0.09"),
    "accounting_straight_line_depreciation": (["a0", "b0", "b1"], "({0} - {1}) / {2}"),
    "cost_bep_sales": (["a0", "p1"], "{0} / {1}"),
    "accounting_cogs": (["a0", "a5", "b0"], "{0} + {1} - {2}"),
    "accounting_eps": (["a0", "b0", "b1"], "({0} - {1}) / {2}"),
    "cost_overhead_application_variance": (["a0", "b0", "a3", "b1"], "{0} - {1} * {2} / {3}"),
    "cost_margin_of_safety_ratio": (["a0", "b0"], "({0} - {1}) / {0}"),
    "cost_dol_profit_change": (["a0", "b1", "p0"], "{0} * {2} / {1}"),
    "cost_special_order_profit": (["a100", "b0", "b5"], "({0} - {1}) * {2}"),
    "finance_growing_perpetuity_pv": (["a0", "p60", "p0"], "{0} / ({1} - {2})"),
    "finance_perpetuity_pv": (["a0", "p1"], "{0} / {1}"),
    "finance_ordinary_annuity_pv": (["a0", "b1"], "{0} * {1}"),
    "finance_npv_annuity_factor": (["a0", "b1", "a7"], "{0} * {1} - {2}"),
    "finance_capm_required_return": (["p0", "b0", "p5"], "{0} + {1} * ({2} - {0})"),
    "finance_portfolio_expected_return": (["p0", "p3", "q0", "p7"], "{0} * {1} + {2} * {3}"),
    "finance_portfolio_std_dev": (["p1", "p9", "p0"], "sqrt(0.25 * {0} * {0} + 0.25 * {1} * {1} + 0.5 * {2} * {0} * {1})"),
    "finance_wacc": (["p0", "p5", "q0", "p2", "p10"], "{0} * {1} + {2} * {3} * (1 - {4})"),
    "finance_put_call_parity": (["a0", "a3", "a9", "p1"], "{0} - {1} + {2} / (1 + {3})"),
    "accounting_impairment_loss": (["a50", "b0", "a1"], "greatest({0} - greatest({1}, {2}), 0)"),
    "accounting_transaction_price_allocation": (["a0", "b1", "a9"], "{0} * {1} / {2}"),
    "tax_entertainment_expense_limit": (["a50000000", "a12000000", "a900000000"], "greatest({0} - {1} - 0.003 * {2}, 0)"),
    "tax_vat_output_deemed_supply": (["a0", "b0"], "0.1 * ({0} + {1})"),
    "tax_vat_payable": (["a100", "b0", "b5"], "{0} - {1} * 10 / 110 - {2}"),
    "tax_vat_common_input_apportionment": (["a0", "a5", "a9"], "{0} * {1} / ({1} + {2})"),
    "tax_acquisition_base_rate": (["a0", "b0", "p1"], "({0} + {1}) * {2}"),
    "cost_manufacturing_flow": (["a0", "a1", "b0", "a2", "b5"], "{0} + {1} - {2} + {3} - {4}"),
    "cost_bep_units_and_safety_sales": (["a0", "p1", "p20"], "{0} / {1} / (1 - {2})"),
    "tax_financial_income_grossup": (["a15000000", "b0", "a9000000"], "{0} + {1} + {2} + CASE WHEN {0} + {1} + {2} > 20000000 THEN greatest(0, {2} - greatest(0, 20000000 - {0} - {1})) ELSE 0 END * 0.10"),
    "tax_acquisition_with_surtaxes": (["a0", "=4%"], "{0} * {1} + {0} * ({1} - 0.02) * 0.20 + {0} * 0.02 * 0.10"),
    "economics_quantity_theory_inflation": (["p9", "p0"], "{0} - {1}"),
    "economics_uip_return_gap": (["p9", "p0", "p3"], "{0} - ({1} + {2})"),
    "management_eoq": (["a0", "=50", "b1"], "sqrt(2 * {0} * {1} / {2})"),
}
CHOICES = [0.05, 0.5, 20.0, 45.0, 100.0, 400.0, 2000.0, 40000.0, 1e6, 2.4e7, 3.5e7]
BANK_CHOICE, BANK_SURE = 2, 0.55


def _written(value: str) -> Column:
    kind, more = value[0], value[1:]
    if kind == "=":
        return F.lit(more)
    n = F.round("p_retailprice").cast("long") if kind == "a" else F.col("p_size").cast("long")
    n = F.lit(100) - n if kind == "q" else n + int(more)
    return F.concat(n.cast("string"), F.lit("%" if kind in "pq" else ""))


def _computed(value: str) -> str:
    kind, more = value[0], value[1:]
    if kind == "=":
        return f"({float(more.rstrip('%')) / (100 if more.endswith('%') else 1)})::DOUBLE"
    return {"a": f"(round(p_retailprice) + {more})::DOUBLE", "b": f"(p_size + {more})::DOUBLE", "p": f"((p_size + {more})::DOUBLE / 100)", "q": "((100 - p_size)::DOUBLE / 100)"}[kind]


def _questions(spark, d) -> DataFrame:
    """question_id, text, choices: one question a part, of each rule and, at the end of the turn, two that no rule answers."""
    texts = []
    for r in solve.RULES:
        values = RULE_VALUES[r.rule_id][0]
        said = [F.concat(F.lit(f"{label} "), _written(v), F.lit(", ")) for label, v in zip(r.labels, values, strict=True)]
        texts.append(F.concat(*said, F.lit("by " + " and ".join(g.capitalize() for g in r.guards) + "?")))
    texts += [F.concat(F.lit("Who wrote it "), F.col("p_size").cast("string"), F.lit("?"))] * 2
    turn, text = (F.col("p_partkey") % len(texts)).cast("int"), F.lit(None).cast("string")
    for k, t in enumerate(texts):
        text = F.when(turn == k, t).otherwise(text)
    return table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.transform(F.array(F.struct("p_size", "p_retailprice")), lambda x: text)[0].alias("text"), F.array(*[F.lit(x) for x in CHOICES]).alias("choices"))


_N = len(RULE_VALUES) + 2
_IDS = list(RULE_VALUES)
_VALUE_SQL = f"CASE p_partkey % {_N} " + " ".join(f"WHEN {k} THEN {f.format(*map(_computed, v))}" for k, (v, f) in enumerate(RULE_VALUES.values())) + " END::DOUBLE"


@query(
    f"""WITH v AS (SELECT p_partkey AS question_id, p_partkey % {_N} AS k, {_VALUE_SQL} AS value FROM part),
e AS (SELECT question_id, abs(unnest({CHOICES}::DOUBLE[]) - value) AS d, unnest(range({len(CHOICES)})) AS i FROM v), c AS (SELECT question_id, arg_min(i, (d, i)) AS choice FROM e WHERE d IS NOT NULL GROUP BY question_id)
SELECT question_id, {[*_IDS, 'known_solution_bank', 'unsupported']}[1 + k] AS rule_id, round(value, 4) AS value, coalesce(choice, CASE WHEN k = {_N - 2} THEN {BANK_CHOICE} ELSE -1 END)::INT AS choice,
  {[*[next(r.confidence for r in solve.RULES if r.rule_id == i) for i in _IDS], BANK_SURE, 0.0]}[1 + k]::DOUBLE AS confidence FROM v LEFT JOIN c USING (question_id)"""
)
def formula_rules(spark, d) -> DataFrame:
    """Questions through the formula rules, every rule among them: the first that does not abstain, and the nearest choice;
    a bank of known answers where none does."""
    key = F.col("p_partkey")
    bank = table(spark, d, "part").where(key % _N == _N - 2).select(key.alias("question_id"), F.lit(BANK_CHOICE).alias("choice"), F.lit(BANK_SURE).alias("confidence"))
    return solve.solve(_questions(spark, d), bank).withColumn("value", F.round("value", 4))


@query(
    """WITH s AS (SELECT o_orderkey, o_orderkey % 40 + 1 AS cost, o_orderkey % 9 + 1 AS q1, o_orderkey % 50 + 1 AS p1, o_orderkey % 7 AS q2, o_orderkey % 30 + 2 AS p2 FROM orders),
m AS (SELECT *, q1 * p1 + q2 * p2 AS cash, (q1 + q2) * cost AS book FROM s)
SELECT o_orderkey, cash::DOUBLE AS cash, (cash - book)::DOUBLE AS gain, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN cash >= book THEN 1 ELSE 2 END::INT AS choice FROM m"""
)
def treasury_shares(spark, d) -> DataFrame:
    """Sales of own shares: cash, the gain over cost netted over all sales, and the entry among the choices that names them."""
    k = F.col("o_orderkey")
    sales = F.array(F.struct((k % 9 + 1).cast("double").alias("qty"), (k % 50 + 1).cast("double").alias("price")), F.struct((k % 7).cast("double").alias("qty"), (k % 30 + 2).cast("double").alias("price")))
    rows = table(spark, d, "orders").select(k, solve.treasury_sales((k % 40 + 1).cast("double"), sales).alias("s"))
    label = F.when(F.col("s.gain") >= 0, "gain on own shares").otherwise("loss on own shares")

    def named(word: str) -> Column:
        cash, gain = F.format_number("s.cash", 0), F.format_number(F.abs("s.gain"), 0)
        return F.concat(F.lit("equity up "), cash, F.lit(", "), F.lit(word), F.lit(" "), gain, F.when(k % 3 == 0, " in income").otherwise(" in capital"))

    choices = F.array(F.lit("equity up 1, gain on own shares 0 in capital?"), named("gain on own shares"), named("loss on own shares"))
    found = solve.entry_choice(choices, [F.col("s.cash"), F.abs("s.gain")], label, ["capital", "equity up"], ["income", "?"])
    return rows.select(k, "s.cash", "s.gain", found.cast("int").alias("choice"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE 100000 + o_orderkey % 900 + (1000 + o_orderkey % 500) - (2000 + o_orderkey % 70) + 3000 END::DOUBLE AS income FROM orders"""
)
def taxable_income(spark, d) -> DataFrame:
    """Net income with its adjustments, line by line; no answer where a line has no sign or several amounts."""
    k = F.col("o_orderkey")

    def line(words: str, n: Column, odd: Column) -> Column:
        return F.concat(F.lit(words), F.format_number(n, 0), odd)

    none = F.lit("")
    text = F.concat_ws(
        "\n",
        line("Net income: ", 100000 + k % 900, none),
        line("Over the limit ", 1000 + k % 500, F.when(k % 11 == 0, " of 9,999").otherwise(none)),
        line("Deductible: ", 2000 + k % 70, none),
        F.lit("Note 12 has no amount"),
        line("Not deductible ", F.lit(3000), none),
        F.when(k % 13 == 0, F.lit("Other 500")),
    )
    value = solve.taxable_income(text, "Net income", ["late deduction"], ["Over the limit", "Not deductible"], [("Deductible", "Not deductible")])
    return table(spark, d, "orders").select(k, value.alias("income"))
