"""Secret scans in SQL functions alone: pattern spans, and a randomness battery under false-discovery control.

Pattern spans (``assign``, ``access``, ``hex``) come from one regular expression each. A position is the running sum of
the lengths of what lies between matches: ``\\G(.*?)pattern`` walks a text once, from match to match.

Candidates for ``random`` spans are runs of 20 or more characters of base64 or its URL form that do not lie inside a span
of the patterns. For each one, an encoding is inferred (the smallest alphabet of ENCODINGS that holds its characters), and
these tests are made on its characters:

* chi-squared of the character counts against a uniform alphabet;
* runs: changes between the lower and upper half of the alphabet;
* serial correlation of neighbouring characters' places in the alphabet.

A candidate must pass the battery as random: three times its least p-value is ``battery_p`` or more. Against it stands the
null hypothesis that it is ordinary text, whose letters coincide as in words and seldom change between lower case, upper
case and digits; both statistics are standardized by the length and give one p-value. A run of one class of characters
(digits, or letters of one case) never changes, so its p-value is near 1 and it is never found.

Benjamini and Hochberg's rule over the candidates of the whole corpus keeps the expected share of false finds at
``false_share``. Weights are in proportion to length, as a short string has little power, and are divided by their mean.
What a pattern has already found is no candidate, so it cannot make the rest look more certain. The p-values enter as
counts by tenths of a power of ten, 3,002 at most, so the rule costs one small aggregate over the candidates that the only
pass over the texts has written. Tails use the usual closed approximation exp(-0.717 z - 0.416 z^2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import free_name, let, materialize

# Fixed values of the contract: kinds in their order with their patterns.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs of [0-9a-f]+ of 24 characters or more

RANDOM = "[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from small to large, each with the pattern of strings in it.
ENCODINGS = [
    (DIGITS, "^[0-9]+$"),
    (DIGITS + LOWERS[:6], "^[0-9a-f]+$"),
    (DIGITS + UPPERS[:6], "^[0-9A-F]+$"),
    (LOWERS, "^[a-z]+$"),
    (UPPERS, "^[A-Z]+$"),
    (UPPERS + "234567", "^[A-Z2-7]+$"),
    (DIGITS + LOWERS, "^[0-9a-z]+$"),
    (DIGITS + UPPERS, "^[0-9A-Z]+$"),
    (DIGITS + UPPERS + LOWERS, "^[A-Za-z0-9]+$"),
]
BASE64 = DIGITS + UPPERS + LOWERS + "+/"
FOUND = "array<struct<start:int,kind:int,end:int,match:string,tenths:int,weight:double>>"
SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def _spans(text: Column, kind: int, pattern: str, keep) -> Column:
    """Spans of the matches that ``keep``; the others still use up their characters."""
    gaps = F.regexp_extract_all(text, F.lit(f"(?s)\\G(.*?)(?:{pattern})"), F.lit(1))
    walk = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(keep(x["match"]), F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.aggregate(walk, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("found")), step, lambda s: s["found"])


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, by start, then kind. Cheap tests spare most texts the walk."""
    low = F.lower(text)
    hint = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    assign = F.when(hint, _spans(text, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _spans(text, 1, ACCESS, lambda m: F.length(m) >= 20)).otherwise(_none())
    hexes = F.when(text.rlike("[0-9a-f]{24}"), _spans(text, 2, HEX, lambda m: F.lit(True))).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes))


def candidates(text: Column) -> Column:
    return F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), _spans(text, 3, RANDOM, lambda m: F.lit(True))).otherwise(_none())


def _tail(z: Column) -> Column:
    """P(normal > z)."""
    a = F.abs(z)
    p = F.least(F.exp(-0.717 * a - 0.416 * a * a), F.lit(1.0)) * F.lit(0.5)
    return F.greatest(F.when(z >= 0, p).otherwise(1 - p), F.lit(1e-290))


def _squares(text: Column, alphabet: Column) -> Column:
    """The sum of squared character counts over an alphabet."""
    n = F.length(text)
    return F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, c: s + F.pow((n - F.length(F.replace(text, c, F.lit("")))).cast("double"), F.lit(2.0)))


def battery(text: Column, alphabet: Column) -> Column:
    """Three times the least of the three p-values under a uniform ``alphabet``."""
    n, size = F.length(text).cast("double"), F.length(alphabet).cast("double")
    chi = _squares(text, alphabet) * size / n - n
    fit = _tail((chi - (size - 1)) / F.sqrt(2.0 * (size - 1)))

    def ordered(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        steps = F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1)))
        zero = F.struct(F.lit(0.0).alias("product"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("spread"), F.lit(0.0).alias("high"))
        half = size / 2

        def step(s: Column, i: Column) -> Column:
            a, b = F.get(x, i - 1), F.get(x, i)
            return F.struct(
                (s["product"] + (a - mean) * (b - mean)).alias("product"),
                (s["changes"] + ((a >= half) != (b >= half)).cast("double")).alias("changes"),
                (s["spread"] + (b - mean) * (b - mean)).alias("spread"),
                (s["high"] + (b >= half).cast("double")).alias("high"),
            )

        def p(s: Column) -> Column:
            first = F.get(x, F.lit(0))
            spread, high = s["spread"] + (first - mean) * (first - mean), s["high"] + (first >= half).cast("double")
            serial = (s["product"] / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
            expected = 2 * high * (n - high) / n
            runs = (s["changes"] - expected) / F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(0.25)))
            return 2 * _tail(F.greatest(F.abs(serial), F.abs(runs)))

        return let(F.aggregate(steps, zero, step), p)

    places = F.transform(F.split(text, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return 3 * F.least(fit, let(places, ordered))


def _text_p(text: Column) -> Column:
    """The p-value of the null hypothesis that this is ordinary text."""
    n = F.length(text).cast("double")
    # words' letters coincide with probability 0.065 (pairs: standard deviation about 0.03 / sqrt(n)),
    # and 0.15 of the neighbours in names made of words, numbers and capitals differ in class.
    pairs = (_squares(F.translate(text, "-_", "+/"), F.lit(BASE64)) - n) / (n * (n - 1))
    rare = (0.065 - pairs) / (0.12 / F.sqrt(n))
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "+/_-", "    ")
    changes = n - 1 - (F.length(classes) - F.length(F.regexp_replace(classes, "(.)(?=\\1)", "")))
    mixed = (changes - 0.15 * (n - 1)) / F.sqrt(0.15 * 0.85 * (n - 1))
    return _tail((rare + mixed) / 2**0.5)


def weight_of(text: Column) -> Column:
    """A candidate's weight before it is divided by the mean of all."""
    return F.least(F.length(text) / 32.0, F.lit(4.0))


def evidence(text: Column) -> Column:
    """-log10 of the p-value against ordinary text over the weight, in tenths (0 to 3000); -1 if the battery fails it."""
    alphabet = F.lit(BASE64)
    for letters, pattern in reversed(ENCODINGS):
        alphabet = F.when(text.rlike(pattern), letters).otherwise(alphabet)
    plain = F.struct(F.translate(text, "-_", "+/").alias("t"), alphabet.alias("a"))
    passed = let(plain, lambda x: battery(x["t"], x["a"]))
    tenths = F.floor(F.least(-F.log10(_text_p(text) / weight_of(text)) * 10, F.lit(3000.0))).cast("int")
    return F.when(passed >= 0.001, F.greatest(tenths, F.lit(0))).otherwise(F.lit(-1))


def judged_candidates(text: Column, base: Column) -> Column:
    """Candidates that no span of ``base`` covers, with their evidence and weight."""
    open_ones = F.filter(candidates(text), lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return F.transform(
        open_ones,
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["match"].alias("match"), evidence(s["match"]).alias("tenths"), weight_of(s["match"]).alias("weight")
        ),
    ).cast(FOUND)


def discovery_threshold(judged: DataFrame, found: str, false_share: float = 0.001) -> int | None:
    """The least evidence (in tenths) whose discoveries hold false finds to ``false_share``; None: no discovery. Evidence has
    the raw weights, so dividing all weights by their mean is one factor on every p-value."""
    each = judged.where(F.size(found) > 0).select(F.inline(found))
    counts = each.groupBy("tenths").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    rows = {r["tenths"]: (r["n"], r["w"]) for r in counts.collect()}  # 3,002 rows at most
    total, mean = sum(n for n, _ in rows.values()), sum(w for _, w in rows.values()) / max(1, sum(n for n, _ in rows.values()))
    above, best = 0, None
    for tenths in sorted((t for t in rows if t >= 0), reverse=True):
        above += rows[tenths][0]
        if total * mean * 10 ** (-tenths / 10) <= false_share * above:
            best = tenths
    return best


def scan(docs: DataFrame, false_share: float = 0.001, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end, match), positions in code points, end exclusive,
    kinds as in KINDS, by start, then kind. A column of one of these names is replaced.

    ``carry``: the columns of ``docs`` that the result has (all, unless given); the texts are read once, and these columns
    are written to the shared folder with what was found in them. A null or empty text has no span. Rows are judged one by
    one, so repeated rows repeat their spans; no rows give no rows. A ``random`` span may overlap a span of the patterns or
    hold it, but is never inside one.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("base", "spans")]
    name = free_name(kept, "found")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    once = docs.select(*kept, let(base_spans(text), lambda b: F.struct(b.alias("base"), judged_candidates(text, b).alias("more"))).alias(name))
    once = materialize(once.select(*kept, F.col(f"{name}.base").alias("base"), F.col(f"{name}.more").alias(name)), "secrets-found")
    least = discovery_threshold(once, name, false_share)
    if least is None:
        return once.select(*kept, "base", F.col("base").alias("spans"))
    new = F.transform(F.filter(name, lambda s: s["tenths"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
    return once.select(*kept, "base", F.when(F.size(name) == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", new))).alias("spans"))


def said(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["out"], F.array(kept, F.lit(mark)))).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
