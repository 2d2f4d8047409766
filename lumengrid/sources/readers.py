"""Readers of the engine's file formats: every one takes a schema, so nothing is inferred and columns are pruned."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEM = "problem_id string, subject string, unit string, concept_tags array<string>, time_strategy struct<target_seconds:int,skip_threshold_seconds:int,exam_room_rule:string>"
RULE = "rule_key string, rule_name string, condition_text string, action_text string, exception_text string, applicable_stages array<string>, applicable_subjects array<string>, required_risk_tags array<string>, source_signal_count int, source_case_ids array<string>, confidence double, review_status string"
USER_STATE = "user_id string, target_exam string, days_until_exam int, available_hours_per_day double, current_stage string, subject_states array<struct<subject:string,accuracy:double,time_overrun_rate:double,risk_tags:array<string>,concept_mastery:array<struct<concept:string,mastery:double>>>>"
CHUNK = "chunk_id string, subject string, unit string, topic_tags array<string>, text string, keywords array<string>, source struct<title:string,reference:string>, applicable_year int"
TERM = "term_id string, name_ko string, name_en string, aliases array<string>, subject string, unit string, definition string, formula string, confusable_with array<struct<term_id:string,reason:string>>, prerequisite_terms array<string>"
EDGE = "from_term string, to_kind string, to_id string, relation string, weight double, evidence string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the path, on whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_documents(spark: SparkSession, folder: str, schema: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """One JSON document a file, with the file's ``path``; order by it where the order of files matters."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.json(folder).withColumn("path", F.col("_metadata.file_path"))


def listed_arrays(spark: SparkSession, paths: str, schema: str, recursive: bool = False) -> DataFrame:
    """The elements of the top-level JSON arrays in several files or folders, named in one text with commas between them;
    blanks and empty names do not count, and a path that is named twice is read once. Each file is a task of its own. A
    name that matches nothing is an error, as a list that is written out is meant. ``path`` names each row's file."""
    named = list(dict.fromkeys(p.strip() for p in paths.split(",") if p.strip()))
    missing = [p for p in named if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    if not named:
        return spark.createDataFrame([], schema).withColumn("path", F.lit(None).cast("string"))
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", recursive)
    return reader.json(named).withColumn("path", F.col("_metadata.file_path"))


def readable(texts: DataFrame, subject: Column, least: int = 500) -> DataFrame:
    """Adds subject and ``skipped``: why a text goes no further, null if it does. ``no_subject``: its file's name tells none;
    ``scanned``: fewer than ``least`` characters without the blanks around them, as scans without a text layer have; a null
    text is scanned. Rows stay, so what was skipped can be counted and restored otherwise."""
    body = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n"))
    told = texts.withColumn("subject", subject)
    return told.withColumn("skipped", F.when(F.col("subject").isNull(), "no_subject").when(F.length(body) < least, "scanned"))


def decision_rules(spark: SparkSession, folder: str) -> DataFrame:
    return json_documents(spark, folder, RULE, "*.decision_rule.json").drop("path")


def problem_files(spark: SparkSession, folder: str) -> DataFrame:
    return json_documents(spark, folder, PROBLEM).drop("path")


def user_state(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, USER_STATE).drop("path")


def nested_array(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """The rows of a top-level array field; a missing file, or a null array, has none."""
    schema = f"{field} array<struct<{element}>>"
    if not exists(spark, path):
        return spark.createDataFrame([], schema).select(F.inline(field))
    return json_documents(spark, path, schema).select(F.inline(field))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = json_documents(spark, folder, CHUNK).drop("path")
    return rows.withColumns({"source_title": F.col("source.title"), "source_reference": F.col("source.reference")}).drop("source")


def terms(spark: SparkSession, folder: str, brief: bool = False) -> DataFrame:
    """All fields, or the four that matching needs."""
    rows = json_documents(spark, folder, TERM, "*.term.json").drop("path")
    return rows.select("term_id", "name_ko", "aliases", "confusable_with") if brief else rows


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing path is empty, blank and broken lines are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType(T._parse_datatype_string(schema).fields + [T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def edges(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, EDGE)


def latest_by_id(rows: DataFrame, key: str, order: str = "path") -> DataFrame:
    """Of the rows of a key, the one with the last ``order``."""
    last = W.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def indexed(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """Files at any depth, indexed by key; the last path wins."""
    return latest_by_id(json_documents(spark, folder, schema, recursive=True), key)


def year_files(spark: SparkSession, folder: str, schema: str, year: int | None = None, subject: str | None = None) -> DataFrame:
    """Files under one folder a year (its name is the year), of one year or subject where asked, by year, subject, id."""
    rows = json_documents(spark, f"{folder}/{year or '*'}", schema).withColumn("year", F.regexp_extract("path", "/([0-9]{4})/[^/]*$", 1).try_cast("int"))
    if subject is not None:
        rows = rows.where(F.col("subject") == subject)
    return rows.orderBy(F.coalesce("year", F.lit(0)), "subject", "question_id")


def csv_with_header(spark: SparkSession, path: str, schema: str, defaults: dict[str, int] | None = None) -> DataFrame:
    """CSV whose first line may carry a byte-order mark; ``defaults`` are for integers that are empty or not numbers."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    raw = spark.read.option("header", True).option("enforceSchema", True).schema(", ".join(f"{n} string" for n in names)).csv(path)
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    defaults = defaults or {}
    return raw.select(*[(F.coalesce(F.col(n).try_cast(kinds[n]), F.lit(defaults[n])) if n in defaults else F.col(n).try_cast(kinds[n])).alias(n) for n in names])


def decoded(files: DataFrame, charsets: tuple[str, ...] = ("utf-8", "cp949", "euc-kr")) -> DataFrame:
    """files: path, content (binary), charset (declared, may be null). Adds text: the first charset that decodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(content: bytes, declared: str | None) -> str:
            for name in ([declared] if declared else []) + list(charsets):
                try:
                    return content.decode(name)
                except (UnicodeDecodeError, LookupError):
                    continue
            return content.decode("utf-8", "replace")

        for b in batches:
            yield pd.DataFrame({"path": b.path, "text": [one(bytes(c or b""), d) for c, d in zip(b.content, b.charset, strict=True)]})

    return files.select("path", "content", "charset").mapInPandas(run, "path string, text string")


def zip_members(files: DataFrame, ending: str = ".pdf") -> DataFrame:
    """files: path, content (binary zip archives). path, name, size and content of the members whose names end so, without
    their folders; names that are not marked as UTF-8 are read as Korean where they can be. Broken archives have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        for member in archive.infolist():
                            if not member.is_dir() and member.filename.lower().endswith(ending):
                                data = archive.read(member)
                                rows.append((path, _korean(member).rsplit("/", 1)[-1], len(data), data))
                except (zipfile.BadZipFile, RuntimeError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "name", "size", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, content binary")


def _korean(member: zipfile.ZipInfo) -> str:
    if member.flag_bits & 0x800:  # marked as UTF-8
        return member.filename
    try:
        return member.filename.encode("cp437").decode("cp949")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return member.filename


def attachment_links(html: Column, extensions: tuple[str, ...] = ("pdf", "hwp", "zip")) -> Column:
    """The distinct links of a page that end in one of the extensions, in order."""
    links = F.regexp_extract_all(html, F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(links, lambda x: F.lower(x).rlike("\\.(" + "|".join(extensions) + ")([?#].*)?$")))


def merged(base: DataFrame, fill: DataFrame, key: str) -> DataFrame:
    """base with the rows of fill in place of, or beside, those of the same key."""
    return base.join(fill.select(key), key, "left_anti").unionByName(fill, allowMissingColumns=True)
