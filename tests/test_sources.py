"""Readers, sinks and streams on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from lumengrid.sources import readers, sinks
from lumengrid.streaming import ingest


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_json_documents(spark, tmp_path):
    put(tmp_path, "a.decision_rule.json", {"rule_key": "r1", "confidence": 0.5, "other": 1})
    put(tmp_path, "b.json", {"rule_key": "not"})
    (r,) = readers.decision_rules(spark, str(tmp_path)).collect()
    assert (r.rule_key, r.confidence, r.applicable_stages) == ("r1", 0.5, None)


def test_nested_arrays_and_missing_files(spark, tmp_path):
    put(tmp_path, "m.json", {"items": [{"id": "x"}, {"id": "y"}]})
    put(tmp_path, "n.json", {"items": None})
    assert [r.id for r in readers.nested_array(spark, str(tmp_path / "m.json"), "items", "id: string").collect()] == ["x", "y"]
    assert readers.nested_array(spark, str(tmp_path / "n.json"), "items", "id: string").count() == 0
    assert readers.nested_array(spark, str(tmp_path / "gone.json"), "items", "id: string").count() == 0
    assert readers.edges(spark, str(tmp_path / "gone.jsonl")).count() == 0


def test_lines_skip_what_is_broken(spark, tmp_path):
    put(tmp_path, "e.jsonl", '{"from_term": "a", "weight": 1}\n\n{broken\n{"from_term": "b"}\n')
    assert sorted(r.from_term for r in readers.edges(spark, str(tmp_path / "e.jsonl")).collect()) == ["a", "b"]


def test_last_path_wins_and_years(spark, tmp_path):
    put(tmp_path, "x/1.json", {"question_id": "q", "v": 1})
    put(tmp_path, "y/2.json", {"question_id": "q", "v": 2})
    assert [r.v for r in readers.indexed(spark, str(tmp_path), "question_id string, v int", "question_id").collect()] == [2]
    put(tmp_path, "z/2024/1.json", {"question_id": "b", "subject": "tax"})
    put(tmp_path, "z/2023/1.json", {"question_id": "a", "subject": "tax"})
    schema = "question_id string, subject string"
    assert [(r.question_id, r.year) for r in readers.year_files(spark, str(tmp_path / "z"), schema).collect()] == [("a", 2023), ("b", 2024)]
    assert [r.question_id for r in readers.year_files(spark, str(tmp_path / "z"), schema, 2024, "tax").collect()] == ["b"]


def test_csv_with_mark_and_defaults(spark, tmp_path):
    put(tmp_path, "s.csv", "﻿asset_id,priority\na,\nb,7\nc,x\n")
    rows = readers.csv_with_header(spark, str(tmp_path / "s.csv"), "asset_id string, priority int", {"priority": 3})
    assert sorted(map(tuple, rows.collect())) == [("a", 3), ("b", 7), ("c", 3)]


def test_charsets(spark):
    files = spark.createDataFrame([("a", bytearray("가나".encode("cp949")), None), ("b", bytearray("é".encode("latin-1")), "latin-1"), ("c", bytearray(b"plain"), "no-such")], "path string, content binary, charset string")
    assert sorted(map(tuple, readers.decoded(files).collect())) == [("a", "가나"), ("b", "é"), ("c", "plain")]


def test_sinks(spark, tmp_path):
    target = spark.createDataFrame([(1, 1, "old", "c1"), (2, 1, "two", "c2")], "k int, at int, v string, created string")
    batch = spark.createDataFrame([(1, 2, "new", "c9"), (1, 3, "newer", "c9"), (3, 1, "three", "c3")], "k int, at int, v string, created string")
    got = sorted((r.k, r.v, r.created) for r in sinks.upserted(target, batch, ["k"], "at", ["created"]).collect())
    assert got == [(1, "newer", "c1"), (2, "two", "c2"), (3, "three", "c3")]
    assert [r.k for r in sinks.inserted_or_ignored(target, batch, ["k"], "at").collect()] == [3]
    assert readers.merged(target, batch.where("k = 3"), "k").count() == 3
    edges = spark.createDataFrame([("b", "x", "1", "r", 1.0, 'say "hi"'), ("a", "x", "1", "r", 2.0, None)], readers.EDGE)
    for _ in range(2):
        sinks.write_edges(edges, str(tmp_path / "edges"))
        lines = [r.value for r in spark.read.text(str(tmp_path / "edges")).orderBy("value").collect()]
        assert lines[0] == '{"evidence": "say \\"hi\\"", "from_term": "b", "relation": "r", "to_id": "1", "to_kind": "x", "weight": "1.0"}'


def test_stream_log_is_idempotent_across_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "user_id long, event_id long")
    src, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    for _ in range(2):
        rows.write.mode("append").parquet(src)
        ingest.append_once(ingest.event_stream(spark, src, "user_id long, event_id long", 1), log, mark).awaitTermination()
    assert sorted((r.user_id, r.event_id) for r in spark.read.parquet(log).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_stream_counts_leave_out_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'view' AS event_type UNION ALL SELECT timestamp'2024-01-01 00:00:50', 'view'").coalesce(1).write.parquet(src)
    stream = ingest.counts_by_minute(ingest.event_stream(spark, src, "ts timestamp, event_type string"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("counts").select(F.col("n")).collect()] == [2]


def test_zip_members_with_repaired_names(spark):
    import io
    import zipfile

    def archive(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members:
                z.writestr(zipfile.ZipInfo(name), data)
        return out.getvalue()

    raw = archive(("a/b.PDF", b"1"), ("c.txt", b"2"), ("x.pdf", b"345"))
    korean = bytearray(archive(("AAAA.pdf", b"6")))
    name = "회계".encode("cp949")
    korean = bytes(korean).replace(b"AAAA", name)
    files = spark.createDataFrame([("one", raw), ("two", korean), ("broken", b"nothing"), ("none", None)], "path string, content binary")
    got = sorted((r.path, r.name, r["size"]) for r in readers.zip_members(files).collect())
    assert got == [("one", "b.PDF", 1), ("one", "x.pdf", 3), ("two", "회계.pdf", 1)]


def test_listed_arrays_are_read_once_each(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"}, {"id": 2}]', encoding="utf-8")
    (tmp_path / "b.json").write_text("[\n]", encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"id": 3, "t": "한글"}]', encoding="utf-8")
    a, b, c = (str(tmp_path / f"{x}.json") for x in "abc")
    rows = readers.listed_arrays(spark, f" {a}, {b},,{c} ,{a}", "id int, t string")
    assert sorted((r["id"], r["t"], r["path"][-6:]) for r in rows.collect()) == [(1, "x", "a.json"), (2, None, "a.json"), (3, "한글", "c.json")]
    assert readers.listed_arrays(spark, " , ", "id int, t string").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.listed_arrays(spark, f"{a},{tmp_path}/none.json", "id int, t string")


def test_scanned_texts_are_told_and_kept(spark):
    texts = [(1, "tax_2024", "w" * 500), (2, "tax_2024", "  " + "w" * 499 + "\n"), (3, "tax_2024", None), (4, "other", "w" * 900), (5, "other", "")]
    rows = spark.createDataFrame(texts, "id int, name string, text string")
    got = readers.readable(rows, F.when(F.col("name").startswith("tax"), "tax")).collect()
    assert {r["id"]: (r["subject"], r["skipped"]) for r in got} == {1: ("tax", None), 2: ("tax", "scanned"), 3: ("tax", "scanned"), 4: (None, "no_subject"), 5: (None, "no_subject")}
