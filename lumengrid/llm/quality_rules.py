"""Quality rules for documents, with host verdicts under an empirical beta prior; SQL functions alone.

Each text is measured by itself, in one pass and without a shuffle; the figures (a few numbers a row) are written to the
shared folder. Rule failures are then summed by host. Hosts' failure rates get a beta prior whose two parameters come from
the mean and the spread of the rates over all hosts (moments, one row). A host is dropped if it is clearly worse than the
corpus: the odds of its rate, two posterior deviations under the posterior mean, are over ``worst_odds`` times the odds of
the prior's mean. Hosts of one quality differ by chance alone, so among them none goes. Verdicts go back to documents by a
broadcast where the table of hosts is small (both its rows and its characters are counted first), else by a join salted on
both sides, so a host with a third of all documents is spread over ``salts`` partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import let, materialize

# Fixed values of the contract: word separators and symbols.
SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"

#: Hosts whose verdicts are sent to every task: 50,000 rows and 5,000,000 characters at most, both counted first.
FEW_HOSTS = 50_000


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, "[ \t\n\x0b\f\r]+"))


def repeated_words(w: Column) -> Column:
    """How many words lie in a window of three words that is found twice or more. Windows are compared by 64-bit hashes;
    the sort that brings equal ones together is made only for texts that have any."""
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ),
    )


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t\n\x0b\f\r]"))
    dups = F.when(text.contains("\n"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(F.lit(0))
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dups.cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def host_verdicts(figures: DataFrame, worst_odds: float = 3.0) -> tuple[DataFrame, bool]:
    """(host, n_docs, failures, rate (the posterior mean), dropped: one row a host; whether they are few). A null host gets
    no row."""
    hosts = figures.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n_docs")
    sums = [F.count("*").alias("k"), F.sum(F.length("host")).alias("chars"), F.sum("failures").alias("f"), F.sum("n_docs").alias("n")]
    m = hosts.agg(*sums, F.avg(rate).alias("mean"), F.var_samp(rate).alias("spread"), F.avg(1 / F.col("n_docs")).alias("inverse")).first()
    mean = min(max((m["f"] or 0) / (m["n"] or 1), 1e-4), 1 - 1e-4)
    between = max((m["spread"] or 0.0) - mean * (1 - mean) * (m["inverse"] or 0.0), 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0)
    a, b = F.lit(mean * strength) + F.col("failures"), F.lit((1 - mean) * strength) + F.col("n_docs") - F.col("failures")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    odds = worst_odds * mean / (1 - mean)
    dropped = a / (a + b) - 2 * deviation > odds / (1 + odds)
    return hosts.select("host", "n_docs", "failures", (a / (a + b)).alias("rate"), dropped.alias("dropped")), m["k"] <= FEW_HOSTS and (m["chars"] or 0) <= 100 * FEW_HOSTS


def judge(docs: DataFrame, host: Column | None = None, worst_odds: float = 3.0, salts: int = 16) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, host_docs,
    host_failures, host_dropped, kept for each row.

    ``docs``: doc_id, text, source; other columns are ignored. ``host`` is ``source`` unless given. Base rules: fewer than
    50 words, or more than half of the words in repeated windows. ``failed`` adds two rules that count only toward hosts:
    symbols over a tenth of the word characters, and half of the lines or more repeated. A null text has no words and
    fails. A null host counts 0 documents and is never dropped. Repeated rows are judged alike; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select("doc_id", (F.col("source") if host is None else host).cast("string").alias("host"), measures(text).alias("m"), lines.alias("lines")).select("doc_id", "host", "m.*", "lines")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    rows = rows.withColumn("failed", F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars")) | (2 * F.col("n_dup_lines") >= F.col("lines"))).drop("lines")
    figures = materialize(rows, "quality-figures")
    found, few = host_verdicts(figures, worst_odds)
    verdicts = materialize(found.select("host", F.col("n_docs").alias("host_docs"), F.col("failures").alias("host_failures"), F.col("dropped").alias("host_dropped")), "quality-hosts")
    if few:
        joined = figures.join(F.broadcast(verdicts), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = figures.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    filled = {"host_docs": F.coalesce("host_docs", F.lit(0).cast("long")), "host_failures": F.coalesce("host_failures", F.lit(0).cast("long")), "host_dropped": F.coalesce("host_dropped", F.lit(False))}
    return joined.select(*figures.columns, *[c.alias(k) for k, c in filled.items()]).withColumn("kept", ~F.col("base_failed") & ~F.col("host_dropped"))
