"""Text as Column to Column helpers: tokens, containment, sentences, answers, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StructType

# Fixed value: a token is a run of two or more Hangul syllables, ASCII letters or digits.
TOKEN = "([가-힣A-Za-z0-9]{2,})"


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is thus computed once, whatever the optimizer merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """The tokens of a text, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), F.lower)


def holds(text: Column, needle: Column) -> Column:
    """Containment, case-sensitive; a needle of ASCII letters and digits alone must not touch ASCII letters or digits, any
    other one (Hangul, symbols, blanks) is a plain substring. Empty needles do not match."""
    bounded = F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9])"), needle, F.lit("(?![A-Za-z0-9])")))
    return F.contains(text, needle) & F.when(needle.rlike("^[A-Za-z0-9]+$"), bounded).otherwise(F.length(needle) > 0)


def serialized(rows: DataFrame) -> Column:
    """All values of a row as one text: fields in their order, nested structs and lists in theirs, map values by their keys,
    joined by blanks. Null is ``None``, truth values are ``True`` and ``False``, numbers as they are written."""

    def said(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            whole = F.concat_ws(" ", *[said(value[f.name], f.dataType) for f in kind.fields])
        elif isinstance(kind, ArrayType):
            whole = F.array_join(F.transform(value, lambda x: said(x, kind.elementType)), " ")
        elif isinstance(kind, MapType):
            whole = F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: said(e["value"], kind.valueType)), " ")
        elif isinstance(kind, BooleanType):
            whole = F.when(value, "True").otherwise("False")
        else:
            whole = value.cast("string")
        return F.when(value.isNull(), "None").otherwise(whole)

    return F.concat_ws(" ", *[said(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields])


def surface_forms(name: Column, aliases: Column) -> Column:
    return F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda f: F.length(f) >= 2)


def main_concept(tags: Column) -> Column:
    """The first tag that holds a colon; null without one."""
    return F.try_element_at(F.filter(tags, lambda t: F.contains(t, F.lit(":"))), F.lit(1))


def label_variants(label: Column) -> Column:
    """The label with a full-width colon made plain, and what follows its first colon, if that is another non-empty text."""
    whole = F.trim(F.replace(label, F.lit("："), F.lit(":")))
    tail = F.trim(F.when(F.instr(whole, ":") > 0, F.substring(whole, F.instr(whole, ":") + 1, F.length(whole))))
    return F.filter(F.array_distinct(F.array(whole, tail)), lambda v: v.isNotNull() & (v != ""))


def sentences(text: Column, endings: str = "(?<=[.!?。])", least: int = 35, most: int = 360) -> Column:
    """Sentences with squeezed blanks, cut after their ends and at line ends, of a length between the two bounds."""
    parts = F.split(F.regexp_replace(text, endings + "[ \\t]+", "\n"), "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[ \\t\\r]+", " "))), lambda s: F.length(s).between(least, most))


def anchor(sentence: Column) -> Column:
    """Evidence of a sentence without its wording: 12 hex digits of its hash and its first ten tokens."""
    words = F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(1))
    return F.concat(F.lit("sha256:"), F.left(F.sha2(sentence, 256), F.lit(12)), F.lit("; keywords:"), F.array_join(F.slice(words, 1, 10), ","))


def answer_index(text: Column, size: Column, last: bool = False) -> Column:
    """The 0-based choice of the first (or last) ``ANSWER: n`` in a text; -1 if none, or out of range."""
    found = F.regexp_extract_all(text, F.lit("(?i)ANSWER\\s*[:：]\\s*\\(?([0-9]+)"), F.lit(1))
    n = F.try_element_at(found, F.lit(-1 if last else 1)).try_cast("int") - 1
    return F.coalesce(F.when((n >= 0) & (n < size), n), F.lit(-1))


def occurrences(text: Column, patterns: list[str]) -> Column:
    """How many matches all patterns have together; where they overlap, each counts."""
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns[1:]), F.regexp_count(text, F.lit(patterns[0])))


def plain_choice(hash_of: Column, size: Column) -> Column:
    """A choice by the first byte of the id's hash."""
    return F.conv(F.left(F.sha2(hash_of, 256), F.lit(2)), 16, 10).cast("int") % size


def json_object(text: Column) -> Column:
    """The JSON object in a model's text: of a fenced block, else from the first to the last brace, else the whole; null if none parses."""
    fenced = F.nullif(F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), F.lit(""))

    def good(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull(), x)

    return F.coalesce(good(fenced), good(braces), good(text))


def reconciled(answer: Column, choices: Column, given: Column) -> Column:
    """status, index: ok (the answer is the given choice), repaired (another one), unverified (no answer), dropped (none)."""

    def norm(x: Column) -> Column:
        return F.regexp_replace(x, "\\s+", "")

    at = F.array_position(F.transform(choices, norm), norm(answer)) - 1
    status = F.when(answer.isNull() | (F.trim(answer) == ""), "unverified").when(at < 0, "dropped").when(at == given, "ok").otherwise("repaired")
    return F.struct(status.alias("status"), F.when(status == "unverified", given).when(at >= 0, at.cast("int")).alias("index"))
