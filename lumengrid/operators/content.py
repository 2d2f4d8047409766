"""Learning content: solution paths and their reasons, profiles, items with defaults, reviews, exam texts, validations.

Wordings are data: templates come in as small tables or dictionaries, so the rules here hold for any language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families by the end of a path's id, in this order; defaults by difficulty; confidence by review status.
FAMILIES = ["direct", "table", "reverse_check", "choice_elimination", "answer_frame"]
DIFFICULTY = {"easy": (60, 2, "understand"), "mid": (90, 3, "apply"), "hard": (120, 4, "analyze")}
REVIEW_CONFIDENCE = [("expert", 0.95), ("verified", 0.86), ("revised", 0.86)]
VERDICTS = ["approve", "revise", "reject"]
CIRCLED = "①②③④⑤"


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def by_name(name: Column, values: dict, other) -> Column:
    """A value by name, by a chain of cases; ``other`` for a name that is not among them, or null."""
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


# Solution paths


def path_family(path_id: Column) -> Column:
    out = F.lit("general")
    for f in reversed(FAMILIES):
        out = F.when(path_id.endswith(f"_{f}"), f).otherwise(out)
    return out


def with_rationale(paths: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds why, use_when and do_not_use_when of the path's family. templates: family, why, use_when, do_not_use_when; a row
    for each family and one for ``general``, which stands in for families without a row."""
    known = templates.select("family").distinct().withColumn("known", F.lit(True))
    own = paths.withColumn("family", path_family(F.col("path_id"))).join(F.broadcast(known), "family", "left")
    return own.withColumn("family", F.when(F.col("known"), F.col("family")).otherwise("general")).drop("known").join(F.broadcast(templates), "family", "left")


def concept_links(core: Column, signals: Column, role: Column) -> Column:
    """The three links of a path: what the topic needs, what the conditions show, what the path does with them."""
    rows = [(core, "unit_profile", 0.82), (F.array_join(F.slice(signals, 1, 3), " / "), "condition_signal", 0.78), (role, "solution_path", 0.76)]
    return F.array(*[F.struct(label.alias("label"), F.lit(source).alias("source"), F.lit(sure).alias("confidence")) for label, source, sure in rows])


def step_paths(given: Column, step_type: Column, written: Column) -> Column:
    """The ids of a step's paths: the given ones, else three that every step has and one by the kind of assessment."""
    last = F.when(written, "_answer_frame").otherwise("_choice_elimination")
    made = F.array(*[F.concat(step_type, F.lit(x)) for x in ("_direct", "_table", "_reverse_check")], F.concat(step_type, last))
    return F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(made)


def unit_profile(tags: Column, choices: Column, correct: Column, core: Column, seeds: list[str], reasons: list[str]) -> Column:
    """core: the first tag with a colon (else ``core``). signals: the tags without one (else the seeds), filled up with seeds
    if there are fewer than three, five at most. eliminations: a reason for each wrong choice, in turn."""
    colon = F.filter(tags, lambda t: F.contains(t, F.lit(":")))
    plain = F.filter(tags, lambda t: ~F.contains(t, F.lit(":")))
    own = F.when(F.size(plain) > 0, plain).otherwise(texts(seeds))
    filled = F.when(F.size(own) < 3, F.concat(own, F.filter(texts(seeds), lambda s: ~F.array_contains(own, s)))).otherwise(own)
    places = F.filter(F.transform(choices, lambda c, i: i), lambda i: i != correct)
    out = F.transform(places, lambda i, n: F.struct(i.alias("choice_index"), F.get(texts(reasons), n % len(reasons)).alias("reason")))
    return F.struct(F.coalesce(F.get(colon, F.lit(0)), core).alias("core"), F.slice(filled, 1, 5).alias("signals"), out.alias("eliminations"))


def path_of_type(paths: Column, kind: Column) -> Column:
    """The first path of a type; null without one."""
    return F.get(F.filter(paths, lambda p: p["path_type"] == kind), F.lit(0))


def elimination(paths: Column, choice: Column) -> Column:
    """Why a choice goes, by the first path that eliminates choices; null without one."""
    rows = path_of_type(paths, F.lit("choice_elimination"))["eliminations"]
    return F.get(F.filter(rows, lambda r: r["choice_index"] == choice), F.lit(0))


# Items and reviews


def hydrated(items: DataFrame, defaults: dict) -> DataFrame:
    """Missing fields from ``defaults`` and from the difficulty; rights and review status are always those of a draft."""
    out = items.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    level = F.col("difficulty")
    made = {n: by_name(level, {k: v[i] for k, v in DIFFICULTY.items()}, DIFFICULTY["mid"][i]) for i, n in enumerate(("expected_seconds", "difficulty_score", "bloom_level"))}
    return out.withColumns({n: F.coalesce(n, c) for n, c in made.items()} | {"rights_status": F.lit("synthetic_seed"), "review_status": F.lit("ai_draft")})


def review_outcome(raw: Column) -> Column:
    """verdict and issues of a reviewer's JSON: an unknown verdict, a revision without a body and what is no object reject."""
    found = F.from_json(raw, "verdict string, issues array<string>, revised map<string,string>")
    verdict, body = found["verdict"], found["revised"]
    none = F.array().cast("array<string>")
    return (
        F.when(found.isNull() | verdict.isNull(), F.struct(F.lit("reject").alias("verdict"), texts(["no verdict"]).alias("issues")))
        .when(~verdict.isin(VERDICTS), F.struct(F.lit("reject").alias("verdict"), F.array(F.concat(F.lit("unknown verdict: "), verdict)).alias("issues")))
        .when((verdict == "revise") & body.isNull(), F.struct(F.lit("reject").alias("verdict"), texts(["revise without a body"]).alias("issues")))
        .otherwise(F.struct(verdict.alias("verdict"), F.coalesce(found["issues"], none).alias("issues")))
    )


def questionable(agreed: Column, issues: Column) -> Column:
    """Why an item is questionable: the last issue where another solver disagreed; null where none did or none was asked."""
    return F.when(agreed.eqNullSafe(F.lit(False)), F.coalesce(F.try_element_at(issues, F.lit(-1)), F.lit("disagreement")))


def review_confidence(status: Column) -> Column:
    out = F.lit(0.72)
    for word, sure in reversed(REVIEW_CONFIDENCE):
        out = F.when(F.contains(status, F.lit(word)), sure).otherwise(out)
    return out


def countable(items: DataFrame) -> DataFrame:
    """Items that are not flagged; an error if all of them are."""
    kept = items.where(~F.coalesce(F.col("flagged"), F.lit(False)))
    if not kept.limit(1).count() and items.limit(1).count():
        raise ValueError("every item is flagged")
    return kept


# Texts


def explanation_parts(text: Column, keep: int = 5) -> Column:
    """The first lines and sentences of an explanation, without blanks and dashes around them."""
    cut = F.split(F.regexp_replace(text, "([.!?。])[ \t\r\n]+", "$1\n"), "[\r\n]+")
    return F.slice(F.filter(F.transform(cut, lambda p: F.btrim(p, F.lit(" -\t"))), lambda p: p != ""), 1, keep)


def claims_choice(text: Column, mark: str, choice: Column) -> Column:
    """Whether one line or sentence holds both the mark and the choice."""
    cut = F.split(F.regexp_replace(text, "([.!?。])[ \t\r\n]+", "$1\n"), "[\r\n]+")
    return (F.length(choice) > 0) & F.exists(cut, lambda p: F.contains(p, F.lit(mark)) & F.contains(p, choice))


def shows_work(answer: Column) -> Column:
    """A digit, and an equals sign or an arrow."""
    return answer.rlike("[0-9]") & (F.contains(answer, F.lit("=")) | F.contains(answer, F.lit("→")))


def choice_index(token: Column) -> Column:
    """0-based, from a circled or plain digit of 1 to 5; null for anything else."""
    t = F.trim(token)
    return F.when((F.length(t) == 1) & (F.instr(F.lit(CIRCLED), t) > 0), F.instr(F.lit(CIRCLED), t) - 1).when(t.rlike("^[1-5]$"), t.cast("int") - 1)


def lossy(stem: Column, choices: Column) -> Column:
    """Whether a glyph of a private area is left in a stem or choice."""
    return stem.rlike("[\\uE000-\\uF8FF]") | F.exists(choices, lambda c: c.rlike("[\\uE000-\\uF8FF]"))


def numbered_parts(text: Column, marker: str, cap: int | None = None) -> Column:
    """(number, body) of each part that a marker with a number (the pattern's first group) begins; what stands before the
    first marker goes. Bodies are trimmed, and cut at ``cap`` characters where a format has such a limit."""
    numbers = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    bodies = F.slice(F.split(text, marker), F.lit(2), F.size(numbers) + 1)
    trimmed = F.transform(bodies, lambda b: F.btrim(b, F.lit(" \t\r\n")))
    return F.zip_with(numbers, trimmed if cap is None else F.transform(trimmed, lambda b: F.left(b, F.lit(cap))), lambda n, b: F.struct(n.cast("int").alias("number"), b.alias("body")))


def first_keyword(name: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first keyword that a name holds; null without one."""
    out = F.lit(None).cast("string")
    for word, value in reversed(pairs):
        out = F.when(F.contains(name, F.lit(word)), value).otherwise(out)
    return out


def recovered(lossy_items: DataFrame, fills: DataFrame) -> DataFrame:
    """Items with the stem and choices of their transcription, where it is whole: five choices and a stem that is not blank.

    lossy_items: question_id, year, stem, choices and, where the id does not end with it, number (else the id's last three
    digits are the number). fills: year, number, stem, choices."""
    whole = fills.where((F.size("choices") == 5) & (F.trim("stem") != "")).select("year", "number", F.trim("stem").alias("new_stem"), F.transform("choices", lambda c: F.trim(c)).alias("new_choices"))
    keyed = lossy_items if "number" in lossy_items.columns else lossy_items.withColumn("number", F.right("question_id", F.lit(3)).try_cast("int"))
    return keyed.join(whole, ["year", "number"]).select("question_id", F.col("new_stem").alias("stem"), F.col("new_choices").alias("choices"), F.lit("vision_recovered").alias("review_status"))


# Client rules


def problem_score(subject: Column, weakest: Column, review: Column, rights: Column, matches: Column, overrun: Column, kind: Column, stage: Column, paths: Column) -> Column:
    """How well a problem suits today: its subject, review, rights, matched concepts, and what overrun and stage ask for."""
    points = F.when(subject == weakest, 40).otherwise(0) + F.when(review == "expert_reviewed", 8).otherwise(0) + F.when(rights == "synthetic_seed", 4).otherwise(0) + matches
    return points + F.when((F.coalesce(overrun, F.lit(0.0)) >= 0.35) & (kind == "calculation"), 7).otherwise(0) + F.when((stage == "objective_entry") & (paths >= 3), 6).otherwise(0)


def weakness(accuracy: Column, overrun: Column) -> Column:
    return accuracy - overrun * 0.35


def shown_subject(subject: Column, unit: Column) -> Column:
    return F.when(subject.isNull(), "mixed").when((subject == "business") & (unit == "financial_management"), "finance").otherwise(subject)


def first_unique(values: Column, keep: int) -> Column:
    """The first ``keep`` distinct values that are neither null nor empty, in their order."""
    return F.slice(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), 1, keep)


# Validation


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order; a rule that is null is broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def schema_errors(raw: Column, kind: Column, schemas: dict[str, tuple[str, list[str]]]) -> Column:
    """Errors of JSON documents against the schema of their kind (DDL, required fields): ``unknown kind``, ``no object``, else
    ``missing`` for each required field that is absent or of another type."""
    out = texts(["unknown kind"])
    for name, (ddl, required) in schemas.items():
        found = F.from_json(raw, ddl)
        missing = F.filter(F.array(*[F.when(found[c].isNull(), F.lit(f"missing {c}")) for c in required]), lambda x: x.isNotNull())
        out = F.when(kind == name, F.when(found.isNull() | ~F.ltrim(raw).startswith("{"), texts(["no object"])).otherwise(missing)).otherwise(out)
    return out


def ontology_nodes(documents: DataFrame) -> DataFrame:
    """subject_id, node_id, parent_node_id, node_name, node_type, priority: one row a node. documents: raw (JSON with subjects,
    each with nodes that are lists of these five by position)."""
    found = F.from_json("raw", "subjects array<struct<subject_id:string,nodes:array<array<string>>>>")
    rows = documents.select(F.inline(found["subjects"])).select("subject_id", F.explode("nodes").alias("n"))
    names = ["node_id", "parent_node_id", "node_name", "node_type"]
    return rows.select("subject_id", *[F.get("n", F.lit(i)).alias(c) for i, c in enumerate(names)], F.get("n", F.lit(4)).try_cast("int").alias("priority"))


# Stores


def exported(generated: DataFrame, existing: DataFrame, key: str, manual: list[str]) -> DataFrame:
    """generated with the hand-edited fields of what was exported before, where there is such a row."""
    old = existing.select(key, *[F.col(c).alias(f"_{c}") for c in manual], F.lit(True).alias("_there"))
    rows = generated.drop(*manual).join(old, key, "left")
    return rows.select(*[c for c in generated.columns if c not in manual], *[F.col(f"_{c}").alias(c) for c in manual])


def without_user(rows: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """What stays when everything of some users is deleted."""
    return rows.join(users.select(key).distinct(), key, "left_anti")


def attempt_id(*parts: Column) -> Column:
    """An id made of what the attempt is, so a write that runs again makes the same one."""
    return F.concat(F.lit("attempt-"), F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(16)))
