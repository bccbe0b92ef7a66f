from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import findings as fnd
from plumbline.operators import windows
from plumbline.sources import findings as intake
from plumbline.sources import sarif

BASE = {
    "id": "D1", "kind": "ar", "layer": "1", "lens": "D", "title": "t", "evidence": [{"path": "lib/a.ts", "startLine": 3, "endLine": None, "quoted": ["x = 1"]}],
    "symbol": None, "anchor": "a", "what": "w", "why": "y", "fix": None, "alt": None,
    "remediation": {"steps": ["s"], "acceptance": ["c"], "testStrategy": "t", "tradeoff": "o"},
    "severity": "High", "effort": "S", "blastRadius": ["internal"], "class": "polish", "entityStage": None,
    "verify": "Verified", "verifyNote": None, "status": "open", "statusNote": None, "dependsOn": [], "crossCutTag": None,
    "fp": None, "baselineState": None, "driftClass": None, "priorFp": None, "priorId": None,
}


def frame(spark, *changes):
    data = [json.dumps({**BASE, "id": f"D{i}", **c}) for i, c in enumerate(changes)]
    return spark.createDataFrame([(x,) for x in data], "v string").select(F.from_json("v", fnd.FINDING_SCHEMA).alias("r")).select("r.*")


def errors(spark, change, **kw):
    return fnd.validate_records(frame(spark, change), **kw).first()["errors"]


def test_a_clean_record(spark):
    assert errors(spark, {}) == []


CASES = [
    ({"kind": "zz"}, ("not_allowed", "kind", "zz")),
    ({"title": " "}, ("empty", "title", None)),
    ({"status": "new"}, ("not_allowed", "status", "new")),
    ({"severity": "critical"}, ("not_allowed", "severity", "critical")),
    ({"evidence": []}, ("empty_list", "evidence", None)),
    ({"evidence": [{"path": "", "startLine": 0, "quoted": []}]}, ("out_of_range", "evidence[0].startLine", "0")),
    ({"evidence": [{"path": "a/b", "startLine": 5, "endLine": 4, "quoted": ["q"]}]}, ("out_of_range", "evidence[0].endLine", "4")),
    ({"evidence": [{"path": "a/b", "startLine": 5, "quoted": ["q", " "]}]}, ("empty_list", "evidence[0].quoted", None)),
    ({"layer": "one"}, ("bad_format", "layer", "one")),
    ({"lens": "Q"}, ("not_allowed", "lens", "Q")),
    ({"effort": "XL"}, ("not_allowed", "effort", "XL")),
    ({"blastRadius": []}, ("empty_list", "blastRadius", None)),
    ({"remediation": None}, ("absent", "remediation", None)),
    ({"remediation": {"steps": [], "acceptance": ["c"], "testStrategy": "t", "tradeoff": " "}}, ("empty_list", "remediation.steps", None)),
    ({"dependsOn": None}, ("not_a_list", "dependsOn", None)),
    ({"kind": "dr", "lens": "I", "severity": "critical", "why": None, "fix": "f"}, ("empty", "why", "critical")),
    ({"kind": "dr", "lens": "I", "severity": "suggestion", "fix": None}, ("empty", "fix", "suggestion")),
    ({"kind": "dr", "lens": "D", "severity": "discuss"}, ("not_allowed", "lens", "D")),
    ({"baselineState": "odd"}, ("not_allowed", "baselineState", "odd")),
    ({"priorId": " "}, ("blank", "priorId", None)),
]


def test_every_rule(spark):
    df = fnd.validate_records(frame(spark, *[c for c, _ in CASES]))
    got = {r["id"]: r["errors"] for r in df.collect()}
    for i, (change, problem) in enumerate(CASES):
        assert problem in [tuple(e) for e in got[f"D{i}"]], (change, got[f"D{i}"])


def test_all_errors_at_once_and_ids(spark):
    found = errors(spark, {"title": "", "status": "x", "layer": "?"})
    assert len(found) == 3
    # None of several rows with one id is known to be the right one.
    twice = fnd.validate_records(frame(spark, {"id": "A"}, {"id": "A"}, {"id": "B"}))
    assert sorted((r["id"], len(r["errors"])) for r in twice.collect()) == [("A", 1), ("A", 1), ("B", 0)]
    known = spark.createDataFrame([("D0",)], "id string")
    assert [tuple(e) for e in errors(spark, {}, known_ids=known)] == [("taken", "id", "D0")]
    bare = {"evidence": [{"path": "a.ts", "startLine": 1, "quoted": ["q"]}]}
    assert [tuple(e) for e in errors(spark, bare, ambiguous=["a.ts"])] == [("ambiguous", "evidence[0].path", "a.ts")]


def test_demote(spark):
    f = frame(
        spark, {"severity": "High"}, {"severity": "Low"}, {"kind": "dr", "severity": "important", "fix": "f"},
        {"kind": "dr", "severity": "important", "fix": None}, {}, {}, {},
    )
    v = spark.createDataFrame(
        [("D0", "Weakened", "n"), ("D1", "Weakened", "n"), ("D2", "Weakened", " n "), ("D3", "Weakened", "n"), ("D4", "Falsified", "gone"), ("D5", "Weakened", " "), ("D6", "Verified", None)],
        "id string, verdict string, note string",
    )
    got = {r["id"]: (r["severity"], r["status"], r["verifyNote"], r["update_error"]) for r in fnd.demote(f, v).collect()}
    assert got["D0"] == ("Med", "open", "n", None)
    assert got["D1"] == ("Low", "open", "n", None)
    assert got["D2"] == ("suggestion", "open", "n", None)
    assert got["D3"] == ("important", "open", None, "lower tier requires a fix")
    assert got["D4"] == ("High", "withdrawn", "gone", None)
    assert got["D5"] == ("High", "open", None, "verdict requires a note")
    assert got["D6"] == ("High", "open", None, None)


def test_drift(spark, rows):
    s = "id string, title string, fp string"
    cur = spark.createDataFrame([("A", "a", "1"), ("B", "b", "2"), ("C", "c", "3"), ("E", "e", "5")], s)
    prior = spark.createDataFrame([("pA", "a", "1"), ("pA2", "a", "1"), ("pD", "d", "4"), ("pE", "e", "5")], s)
    gone = spark.createDataFrame([("rC", "c", "3"), ("rE", "e", "5")], s)
    got = fnd.drift(cur, prior, gone)
    assert rows(got, "id", "drift_class", "baseline_state", "prior_id") == [
        ("A", "Still-open", "unchanged", "pA2"), ("B", "NEW", "new", None), ("C", "Regressed", "new", "rC"),
        ("E", "Still-open", "unchanged", "pE"), ("pD", "Resolved", "absent", "pD"),
    ]
    assert tuple(fnd.drift_counts(got).first()) == (1, 2, 1, 1, 0)


def test_clusters(spark, rows):
    ev = lambda *p: [{"path": x, "startLine": 1, "quoted": ["q"]} for x in p]
    f = frame(
        spark,
        {"status": "accepted", "evidence": ev("a.ts", "a.ts"), "crossCutTag": "t", "symbol": "s"},
        {"status": "deferred", "evidence": ev("b/a.ts"), "crossCutTag": "t", "symbol": "s", "dependsOn": ["D0", "D1", "D9"]},
        {"status": "accepted", "evidence": ev("c.ts"), "entityStage": "Order", "dependsOn": ["D3"]},
        {"status": "accepted", "evidence": ev("c.ts"), "entityStage": "Order", "crossCutTag": "u", "dependsOn": ["D2"]},
        {"status": "rejected", "evidence": ev("c.ts"), "entityStage": "Order"},
    )
    assert rows(fnd.clusters(f)) == [
        ("dependsOn", "D0 <-> D1", 2, True), ("dependsOn", "D2 <-> D3", 2, False), ("entity", "Order", 2, False), ("file", "c.ts", 2, False), ("symbol", "s", 2, True),
    ]


def test_tally_and_counts(spark, rows):
    f = frame(
        spark,
        {"layer": "1", "status": "accepted", "crossCutTag": "x", "dependsOn": ["D9"]},
        {"layer": "2", "status": "open", "crossCutTag": "x", "lens": "G"},
        {"layer": "0.1", "status": "withdrawn", "crossCutTag": "y"},
        {"layer": "10", "status": "accepted", "crossCutTag": "x"},
    )
    got = rows(fnd.tally(f))
    assert ("1", "tag introduced", "x", 1) in got and ("2", "tag reused", "x", 1) in got and ("10", "tag reused", "x", 1) in got
    assert ("1", "edges", "dependsOn", 1) in got and ("0.1", "status", "withdrawn", 1) in got
    dr = frame(
        spark,
        {"kind": "dr", "severity": "critical", "verify": "Verified"},
        {"kind": "dr", "severity": "critical", "status": "withdrawn", "verify": "Falsified"},
        {"kind": "dr", "severity": "important", "verify": "Weakened"},
        {},
    )
    assert fnd.review_counts(dr).first().asDict() == {
        "critical": 1, "important": 1, "suggestion": 0, "discuss": 0, "verified": 1, "weakened": 1, "falsified": 1, "blockers": 2,
    }


def test_promotion_cascade_and_rank(spark, rows):
    f = frame(
        spark, {"severity": "Med", "entityStage": "E"}, {"severity": "Med", "entityStage": "E"}, {"severity": "Med", "entityStage": "E"}, {"severity": "High", "effort": "L"}, {"severity": "High"},
    )
    assert rows(fnd.interaction_promotion(f)) == [("ar", "E", 3, "High", "Med")]
    members = spark.createDataFrame([("D0", "theme"), ("D1", "theme"), ("D2", "theme")], "id string, cluster string")
    assert [tuple(r) for r in fnd.risk_rank(f, members).collect()] == [("theme", 3, 6.0), ("D4", 1, 3.0), ("D3", 1, 0.75)]
    tags = spark.createDataFrame(
        [("e", "state reached"), ("e", "no event"), ("e", "filter excludes"), ("e", "replay path"), ("g", "no event")], "entity string, tag string"
    )
    assert rows(fnd.cascade(tags)) == [("e", "silent stranded state")]


def test_ndjson_keeps_every_line(spark, rows, tmp_path):
    lines = [
        '{"id": "a", "lens": "D", "quotedLines": ["x = 1"], "symbol": "s"}', "", "   ", "{broken", '["not", "an", "object"]',
        '{"id": "b", "lens": "", "quoted": ["x"]}', '{"id": "c", "lens": "D"}', '{"id": "d", "lens": "D", "quoted": []}',
        '{"id": "e", "lens": "D", "quoted": "x = 1", "symbol": "s"}', '{"id": "f", "lens": "D", "quoted": ["// only a note"]}',
    ]
    (tmp_path / "in.ndjson").write_text("\n".join(lines) + "\n")
    got = intake.read_findings_ndjson(spark, str(tmp_path / "in.ndjson")).collect()
    assert len(got) == 8
    by = {r["id"]: r for r in got if r["id"]}
    assert by["a"]["fp"] == by["e"]["fp"] and by["a"]["error"] is None
    assert [by[k]["fp"] for k in "bcdf"] == [None] * 4 and all(by[k]["error"] for k in "bcdf")
    assert sum(r["error"] == "not_json" for r in got) == 2


def test_append_is_all_or_nothing(spark, rows, tmp_path):
    table, refused = str(tmp_path / "t"), str(tmp_path / "r")
    assert intake.append_findings(frame(spark, {}, {}), table, refused) == (2, 0)
    assert intake.append_findings(frame(spark, {"id": "N1"}, {"id": "D0"}), table, refused) == (0, 2)
    assert intake.append_findings(frame(spark, {"id": "N1"}), table, refused) == (1, 0)
    assert rows(spark.read.parquet(table), "id") == [("D0",), ("D1",), ("N1",)]
    assert spark.read.parquet(table).where("fp IS NULL").count() == 0
    assert spark.read.parquet(refused).count() == 2


def test_sarif(spark, tmp_path):
    f = frame(
        spark, {"fp": "f0"}, {"severity": "Low", "status": "rejected", "statusNote": "no", "lens": "G", "evidence": [{"path": "a\\b.ts", "startLine": 2, "endLine": 4, "quoted": ["x", "y"]}]},
        {"kind": "dr", "lens": "Q", "severity": "discuss", "driftClass": "Regressed", "priorId": "P"},
    )
    sarif.write_sarif(f, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").rglob("part-*.txt"))
    logs = {p.parent.name: json.loads(p.read_text()) for p in files}
    assert set(logs) == {"kind=ar", "kind=dr"} and all(x["version"] == "2.1.0" for x in logs.values())
    got = {r["message"]["text"] + r["ruleId"]: r for x in logs.values() for run in x["runs"] for r in run["results"]}
    assert got["tD"]["level"] == "error" and got["tD"]["rank"] == 90 and "suppressions" not in got["tD"]
    low = got["tG"]
    assert (low["level"], low["ruleIndex"], low["suppressions"][0]["justification"]) == ("note", 1, "no")
    region = low["locations"][0]["physicalLocation"]["region"]
    assert (region["startLine"], region["endLine"], region["snippet"]["text"]) == (2, 4, "x\ny")
    assert low["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a/b.ts"
    assert got["tQ"]["properties"]["driftClass"] == "Regressed" and got["tQ"]["baselineState"] == "new"
    assert [x["id"] for x in logs["kind=ar"]["runs"][0]["tool"]["driver"]["rules"]] == ["D", "G"]
    many = frame(spark, *[{"fp": f"f{i}"} for i in range(50)])
    sarif.write_sarif(many, str(tmp_path / "many"), per_log=10)
    sizes = [len(json.loads(p.read_text())["runs"][0]["results"]) for p in (tmp_path / "many").rglob("part-*.txt")]
    assert sum(sizes) == 50 and 1 < len(sizes) <= 5


def test_sarif_logs_without_a_shuffle_by_kind(spark):
    f = frame(spark, *[{"fp": f"f{i}", "lens": "DG"[i % 2]} for i in range(20)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sarif.sarif_logs(f, per_log=5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan


def test_carry_forward_over_blocks(spark, rows):
    data = [(k, i, v) for k in ("a", "b") for i, v in enumerate([None, "x", None, None, None, None, None, "y", None])]
    df = spark.createDataFrame(data, "k string, i bigint, v string")
    want = [(k, i, v) for k in ("a", "b") for i, v in enumerate([None, "x", "x", "x", "x", "x", "x", "y", "y"])]
    for block in (2, 3, 100):
        assert rows(windows.carry_forward(df, ["k"], "i", "v", "out", block).select("k", "i", "out")) == sorted(want, key=repr)


def test_byte_budget_stops_at_first_misfit(spark, rows):
    df = spark.createDataFrame([("g", 1, "aaa"), ("g", 2, "b" * 20), ("g", 3, "c"), ("h", 1, "z" * 50)], "g string, i int, t string")
    kept = windows.byte_budget(df, ["g"], [F.col("i").asc()], "t", rows=10, size=12)
    assert rows(kept, "g", "i") == [("g", 1)]
    assert rows(windows.budget_report(df, ["g"], kept)) == [("g", 3, 1, 2), ("h", 1, 0, 1)]


@pytest.mark.parametrize("size, want", [(10_000, ["---a---\nr1\nr2\n(... 1 more truncated ...)\n", "---none---\n", "---b---\nq1\n"]), (18, ["---a---\nr1\nr2\n(... 1 more truncated ...)\n", "---none---\n", "---b---\n(... 1 more truncated ...)\n"])])
def test_shared_budget(spark, size, want):
    df = spark.createDataFrame([("a", 1, "r1"), ("a", 2, "r2"), ("a", 3, "r3"), ("b", 1, "q1")], "label string, pos int, line string")
    assert windows.shared_budget(df, ["a", "none", "b"], used=0, max_rows=2, max_bytes=size).first()["texts"] == want


def test_latest_wins(spark, rows):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("j", 2, "only")], "k string, ts int, v string")
    assert rows(windows.latest_wins(df, ["k"], ["ts"])) == [("j", 2, "only"), ("k", 3, "new")]
