from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.findings import FINDING_SCHEMA
from plumbline.plans import lineage
from plumbline.sources import blocks, changes, reports, tables
from plumbline.streaming import intake
from tests.test_findings import frame


def texts(spark, *t):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in t], "text string")


def test_scan_corpus(spark, rows, tmp_path):
    for p in ("lib/a.ts", "lib/deep/b.md", ".github/ci.yml", ".hidden/x.ts", "lib/__tests__/t.ts", "node_modules/m/i.js", "dist/_o.js", "lib/.secret"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}\nmore")
    got = tables.scan_corpus(spark, str(tmp_path))
    assert rows(got, "path") == [(".github/ci.yml",), ("lib/__tests__/t.ts",), ("lib/a.ts",), ("lib/deep/b.md",)]
    assert got.where("path = 'lib/a.ts'").first()["text"] == "text of lib/a.ts\nmore"


def test_tables_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path), "x", "csv")
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert tables.load_table(spark, str(tmp_path), "t", "csv", "a int, b string").first().asDict() == {"a": 1, "b": "x"}


def test_read_changes(spark, rows, tmp_path):
    d = changes.COMMIT_DELIM
    (tmp_path / "log.txt").write_text(f"{d}\nlib/a.ts\nlib\\b.ts\nREADME.md\nlib/a.ts\n\n{d}\nlib/a.ts\nlib/a.test.ts\n{d}\n")
    (tmp_path / "log2.txt").write_text(f"stray.ts\n{d}\nlib/b.ts\n")
    got = changes.read_changes(spark, str(tmp_path))
    assert rows(got.groupBy("item").agg(F.count(F.lit(1)).alias("n"))) == [("lib/a.ts", 2), ("lib/b.ts", 2)]
    assert got.select("basket_id").distinct().count() == 3


def test_blocks(spark, rows):
    t = "target: lib\nfile_count:  12 \n---size-outliers---\nlib/a.ts\t900\t9.0x\n\n---empty---\n---write-sites---\ntable:x\twriters=2\n"
    df = spark.createDataFrame([("r", t)], "source string, text string")
    assert rows(blocks.blocks_of(df), "label", "row_no", "line") == [
        ("empty", None, None), ("size-outliers", 1, "lib/a.ts\t900\t9.0x"), ("write-sites", 1, "table:x\twriters=2"),
    ]
    assert rows(blocks.headers_of(df), "key", "value") == [("file_count", "12"), ("target", "lib")]


def test_write_blocks_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", i, f"row{i}") for i in range(5)], "label string, pos int, line string")
    blocks.write_blocks(df, str(tmp_path / "r"), ["a", "b"], ["target: x"], max_rows=3)
    got, head = blocks.read_blocks(spark, str(tmp_path / "r"))
    assert rows(got, "label", "line") == [("a", "(... 2 more truncated ...)"), ("a", "row0"), ("a", "row1"), ("a", "row2"), ("b", None)]
    assert rows(head, "key", "value") == [("target", "x")]


def test_coverage_formats(spark, rows, tmp_path):
    summary = {"total": {"statements": {"pct": 80}, "branches": {"pct": 70.5}, "functions": {"pct": 60}}, "/r/lib/a.ts": {"statements": {"pct": 50}, "branches": {"pct": 0}}}
    assert rows(reports.coverage_summary(texts(spark, summary), "/r")) == [("lib/a.ts", 50.0, 0.0, 0.0), ("total", 80.0, 70.5, 60.0)]
    final = {"/r/lib/a.ts": {"s": {"0": 1, "1": 0, "2": 5}, "b": {"0": [1, 0], "1": [0]}, "f": {}}}
    assert rows(reports.coverage_final(texts(spark, final), "/r")) == [("lib/a.ts", 67.0, 33.0, 100.0)]
    lcov = "TN:\nSF:/r/lib/a.ts\nLF:4\nLH:1\nBRF:0\nBRH:0\nFNF:3\nFNH:2\nend_of_record\nSF:/r/b.ts\nLF:1\nLH:1\nend_of_record\n"
    (tmp_path / "lcov.info").write_text(lcov)
    got = reports.read_preferred_coverage(spark, {"lcov": str(tmp_path / "lcov.info")}, "/r")
    assert rows(got) == [("b.ts", 100.0, 100.0, 100.0), ("lib/a.ts", 25.0, 100.0, 67.0)]


def test_mutation_bare_and_wrapped(spark, rows):
    files = {"lib\\a.ts": {"mutants": [{"id": "1", "status": "Killed"}, {"id": "2", "status": "Survived"}]}, "lib/none.ts": {"mutants": []}}
    want = [("lib/a.ts", "killed"), ("lib/a.ts", "survived"), ("lib/none.ts", None)]
    assert rows(reports.mutants_of(texts(spark, {"files": files}))) == want
    assert rows(reports.mutants_of(texts(spark, {"results": {"files": files}}))) == want


def test_graph_flavours(spark, rows):
    rich = {
        "modules": [
            {"source": "./a/x.ts", "dependencies": [{"resolved": "b/y.ts", "coreModule": False, "couldNotResolve": False}, {"resolved": "node_modules/l.js"}, {"resolved": "fs", "coreModule": True}, {"resolved": "m", "couldNotResolve": True}, {"module": "c/z.ts"}]},
            {"source": "b/y.ts", "dependencies": []},
        ]
    }
    assert rows(reports.edges_of(texts(spark, rich))) == [("a/x.ts", "b/y.ts"), ("a/x.ts", "c/z.ts")]
    assert rows(reports.edges_of(texts(spark, {"a/x.ts": ["b/y.ts"], "b/y.ts": ["a/x.ts"], "c": []}))) == [("a/x.ts", "b/y.ts"), ("b/y.ts", "a/x.ts")]


def test_declared_model(spark, rows):
    as_map = {
        "elements": {"app.ui": {"kind": "c", "metadata": {"dir": "./ui/"}}, "app.core": {"metadata": {"sources": "core/a; core/b.ts:3"}}, "doc": {}},
        "relations": {"r1": {"source": {"model": "app.ui"}, "target": {"model": "app.core"}, "title": "uses"}},
    }
    as_list = {"model": {"elements": [{"id": "app.ui", "metadata": {"path": "ui"}}], "relations": [{"source": "app.ui", "target": "app.core"}]}}
    elems, rels = reports.model_of(texts(spark, as_map))
    assert rows(elems) == [("app.core", ["core/a", "core/b.ts:3"]), ("app.ui", ["ui"]), ("doc", [])]
    assert rows(rels) == [("app.ui", "app.core", "uses")]
    override = spark.createDataFrame([("app.ui", ["web/"])], "fqn string, prefixes array<string>")
    elems, rels = reports.model_of(texts(spark, as_list), override)
    assert rows(elems) == [("app.ui", ["web"])] and rows(rels) == [("app.ui", "app.core", "")]


def test_scratch_root_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = lineage.scratch_root(spark)
    if configured:
        assert root == configured.rstrip("/")
    assert lineage.scratch_path(spark, "x").startswith(root + "/")


def test_accumulator_merges_pieces(spark, rows):
    acc = lineage.Accumulator(spark.range(0, 1).toDF("x"), "test")
    for i in range(1, 40):
        assert rows(acc.add(spark.range(i, i + 1).toDF("x"))) == [(i,)]
    assert rows(acc.all()) == sorted(((i,) for i in range(40)), key=repr)
    assert [len(level) for level in acc._levels] == [8, 2]


def test_stream_fingerprint_keeps_every_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.ndjson").write_text('{"id": "a", "lens": "D", "quoted": ["x"]}\n\n{bad\n{"id": "b", "lens": "D"}\n')
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    intake.stream_fingerprint(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"] or "", r["fp"] is None) for r in got) == [("", True), ("a", False), ("b", True)]


def test_stream_intake_rejects_repetitions_and_can_be_replayed(spark, rows, tmp_path):
    src, table, refused, state = (str(tmp_path / x) for x in ("src", "t", "r", "s"))
    frame(spark, {}, {}, {"title": " "}, {"id": "D0"}).write.parquet(src)
    run = lambda state: intake.stream_intake(spark.readStream.schema(FINDING_SCHEMA).parquet(src), table, refused, state).awaitTermination()
    tables = lambda: (
        rows(spark.read.parquet(table), "id"), rows(spark.read.parquet(refused).selectExpr("id", "errors.code"))
    )
    run(state)
    first = tables()
    assert first == ([("D0",), ("D1",)], [("D0", ["taken"]), ("D2", ["empty"])])
    # The same micro-batch again, as after a lost commit.
    run(str(tmp_path / "again"))
    assert tables() == first
    frame(spark, {"title": "again"}, {"id": "N"}).write.mode("append").parquet(src)
    run(state)
    assert tables() == ([("D0",), ("D1",), ("N",)], [("D0", ["taken"]), ("D0", ["taken"]), ("D2", ["empty"])])


def test_stream_intake_stores_a_batch_once_before_it_is_split(spark, rows, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(intake, "materialize", lambda df, name, keep=intake.materialize, **how: (stored.append(name), keep(df, name, **how))[1])
    src, table, refused, state = (str(tmp_path / n) for n in ("in", "table", "refused", "state"))
    frame(spark, {"id": "x"}, {"id": "x"}).write.parquet(src)
    intake.stream_intake(spark.readStream.schema(FINDING_SCHEMA).parquet(src), table, refused, state).awaitTermination()
    sides = [rows(spark.read.parquet(side), "id") for side in (table, refused)]
    assert sides == [[("x",)], [("x",)]] and stored == ["checked"]
