from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import compare, grading


def test_ground_quotes(spark, rows):
    lines = spark.createDataFrame(
        [("a.ts", i, t) for i, t in enumerate(["import x", "const  total = sum(a, b);", "}", "return total", "", "x", "last line here"], 1)],
        "path string, line_no bigint, line string",
    )
    ev = spark.createDataFrame(
        [
            ("exact", "a.ts", 2, "const total = sum(a, b);"), ("near", "a.ts", 5, "const total = sum(a, b);"), ("far", "a.ts", 6, "const total = sum(a, b);"),
            ("cut", "a.ts", 2, "const total = su…"), ("longer", "a.ts", 4, "we return total now"), ("short", "a.ts", 6, "x marks"),
            ("gone", "b.ts", 1, "x"), ("beyond", "a.ts", 9, "x"), ("absent", "a.ts", 1, "nothing like it"),
        ],
        "ev_id string, path string, start_line bigint, quote string",
    )
    got = {i: (v, h) for i, v, h in rows(grading.ground_quotes(ev, lines), "ev_id", "verdict", "hint")}
    assert got == {
        "exact": ("grounded", None), "near": ("grounded", None), "far": ("not found", 2), "cut": ("grounded", None), "longer": ("grounded", None),
        "short": ("not found", None), "gone": ("missing document", None), "beyond": ("line beyond end", None), "absent": ("not found", None),
    }


def test_first_lines_against_brute_force(spark, rows):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4)))
    lines = [(f"p{p}", i, " ".join(word() for _ in range(rnd.randrange(0, 9)))) for p in range(3) for i in range(1, 40)]
    lost = []
    for i in range(200):
        text = " ".join(word() for _ in range(rnd.randrange(1, 7))) if i % 3 else rnd.choice([t for _, _, t in lines if t])[rnd.randrange(2) : rnd.randrange(3, 30)].strip()
        # A third of the quotes lie in one document.
        lost.append((f"e{i}", f"p{rnd.choice([0, 0, 1, 2, 3])}", text or "a"))
    want = {}
    for i, p, t in lost:
        hits = [n for q, n, line in lines if q == p and t in line]
        if hits:
            want[i] = min(hits)
    found = grading.first_lines(spark.createDataFrame(lost, "ev_id string, path string, _want string"), spark.createDataFrame(lines, "path string, line_no bigint, _line string"), "path")
    assert dict(rows(found, "ev_id", "hint")) == want and len(want) > 60


def test_recall_against_brute_force(spark, rows):
    rnd = random.Random(4)
    ground = [(rnd.randrange(12), f"p{rnd.randrange(6)}", rnd.choice([None, rnd.randrange(1, 400)]), rnd.randrange(1, 4)) for _ in range(60)]
    least = {}
    for item, _, _, m in ground:
        least[item] = max(least.get(item, 0), m)
    cites = [(f"p{rnd.randrange(8)}", rnd.randrange(1, 400)) for _ in range(40)]
    g = spark.createDataFrame(ground, "item int, path string, line bigint, min_files int")
    c = spark.createDataFrame(cites, "path string, line bigint")
    want = []
    for item in sorted(least):
        mine = [(p, ln) for i, p, ln, _ in ground if i == item]
        hit = {p for p, ln in mine if any(cp == p and (ln is None or abs(cl - ln) <= 60) for cp, cl in cites)}
        want.append((item, len(hit), len({p for p, _ in mine}), len(hit) >= least[item]))
    assert rows(grading.recall(g, c)) == sorted(want, key=repr)


def test_absence(spark, rows):
    units = spark.createDataFrame([(1, "Duplicate parser", "open"), (2, "duplicate parser", "withdrawn"), (3, "other", "open")], "unit_id int, text string, status string")
    cites = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c")], "unit_id int, path string")
    rules = spark.createDataFrame([("R1", "a", "b", "duplicate"), ("R2", "a", "c", "duplicate"), ("R3", "a", "b", "zzz")], "item string, first string, second string, pattern string")
    assert rows(grading.absence(units, cites, rules)) == [("R1", 1, False), ("R2", 0, True), ("R3", 0, True)]


def test_routing_terms_and_numbers(spark, rows):
    text = "---\nfindings: 12\nD: 0\nowner: me\n---\n## Goals\nship Faster\n## Follow-ups\nrefactor\n"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    specs = [("in", "faster", "goal", None), ("leak", "refactor", "goal", "follow"), ("aside", "refactor", "follow", "goal"), ("both", "a", "goal", "follow")]
    assert rows(grading.section_routing(df, specs), "spec", "passed") == [("aside", True), ("both", False), ("in", True), ("leak", False)]
    meta = df.select("doc_id", tx.front_matter(F.col("text")).alias("meta"))
    gates = [("findings", "max", 12), ("findings", "min", 13), ("D", "nonzero", None), ("owner", "present", None), ("none", "max", 5)]
    assert [r["passed"] for r in grading.numeric_gate(meta, gates).collect()] == [True, False, False, True, False]
    got = grading.required_terms(df, ["(?m)^## Goals", "## Missing"], ["(?i)SHIP"]).first()
    assert (got["missing"], got["forbidden_hits"], got["passed"]) == (["## Missing"], ["(?i)SHIP"], False)


def test_rates_votes_confusion(spark, rows):
    e = spark.createDataFrame([("a", True), ("a", False), ("a", True), ("b", None)], "case_id string, passed boolean")
    assert rows(grading.pass_rate(e).withColumn("pass_rate", F.round("pass_rate", 3))) == [("a", 2, 1, 0.667), ("b", 0, 0, 0.0)]
    runs = spark.createDataFrame([(q, i < n) for q, n in (("w", 3), ("x", 2), ("y", 1), ("z", 0)) for i in range(4)], "item string, hit boolean")
    votes = grading.run_votes(runs)
    assert rows(votes, "item", "triggered") == [("w", True), ("x", False), ("y", False), ("z", False)]
    truth = spark.createDataFrame([("w", True), ("x", True), ("y", False), ("z", False)], "item string, should_trigger boolean")
    assert tuple(grading.confusion(votes, truth).first()) == (1, 0, 2, 1, 75, 100, 50)
    never = grading.confusion(votes.where("item = 'z'"), truth).first()
    assert (never["precision"], never["recall"], never["accuracy"]) == (None, None, 100)
    r = spark.createDataFrame([("a", True), ("a", False), ("b", None)], "doc_id string, ok boolean")
    assert rows(grading.citation_rate(r, minimum=50)) == [("a", 2, 1, 50, True), ("b", 0, 0, 100, False)]


def test_compound_contract(spark, rows):
    comp = spark.createDataFrame([("I1",), ("I2",), ("I3",)], "compound string")
    cites = spark.createDataFrame(
        [("I1", "a", True, True), ("I1", "b", True, None), ("I2", "a", True, False), ("I2", "a", True, True)], "compound string, path string, resolved boolean, grounded boolean"
    )
    parts = spark.createDataFrame([("I1", "D1"), ("I2", "D1"), ("I2", "ZZ")], "compound string, id string")
    supplied = spark.createDataFrame([("D1",)], "id string")
    assert rows(grading.compound_contract(comp, cites, parts, supplied)) == [
        ("I1", 2, 0, 0, 1, True), ("I2", 1, 1, 1, 2, False), ("I3", 0, 0, 0, 0, False),
    ]


def test_diffs(spark, rows):
    kv = lambda *x: spark.createDataFrame(list(x), "k string, v string")
    old, new = kv(("a", "1"), ("b", "1"), ("c", None)), kv(("b", "2"), ("c", None), ("d", "1"))
    assert rows(compare.manifest_diff(old, new, ["k"], "v"), "k", "change") == [("a", "Removed"), ("b", "Bumped"), ("d", "Added")]
    sets = lambda *x: spark.createDataFrame(list(x), "k string, v array<string>")
    got = compare.outline_diff(sets(("a", ["x", "y"]), ("b", ["x"]), ("c", ["x"])), sets(("a", ["y", "x", "x"]), ("b", ["z"]), ("d", [])), "k", "v")
    assert rows(got) == [("a", "Unchanged"), ("b", "Changed"), ("c", "Removed"), ("d", "New")]
    peer = compare.peer_diff(old, new, ["k"], "v", spark.createDataFrame([("a",)], "k string"))
    assert rows(peer, "k", "status") == [("a", "Intentionally-absent"), ("b", "Diverged"), ("c", "Mirrored")]


def test_still_present(spark, rows):
    ev = spark.createDataFrame([(1, "a", " x "), (2, "a", "gone"), (3, "zz", "x"), (4, None, "x"), (5, "a", " ")], "ev_id int, path string, verbatim string")
    lines = spark.createDataFrame([("a", "  x"), ("a", "y")], "path string, line string")
    got = compare.still_present(ev, lines, lines.select("path"))
    assert rows(got) == [(1, True), (2, False), (3, False), (4, None), (5, None)]


def test_precedence_fold_scope_keys(spark, rows):
    s = spark.createDataFrame([("A", "export-usage"), ("A", "dead-exports-semantic"), ("D", "dup-candidates")], "subject string, source string")
    assert rows(compare.precedence(s)) == [("A", "dead-exports-semantic", True), ("A", "export-usage", False), ("D", "dup-candidates", True)]
    t = spark.createDataFrame([("knip", "files", "x"), ("depcruise", "warn", "y"), ("other", "z", "z")], "tool string, category string, subject string")
    h = spark.createDataFrame([("big", 6.9), ("mid", 8.9), ("ok", 9.0)], "subject string, score double")
    assert rows(compare.ground_truth_fold(t, h), "id", "severity") == [("CS-big", "critical"), ("CS-mid", "important"), ("DC-y", "important"), ("K-x", "suggestion")]
    kept, dropped = compare.scope_filter(spark.createDataFrame([("a",), ("b",), ("b",)], "item string"), spark.createDataFrame([("a",)], "item string"))
    assert rows(kept) == [("a",)] and dropped.first()[0] == 2
    keys = spark.createDataFrame([("k1",), ("k2",)], "key string")
    tables = spark.createDataFrame([("en",), ("fr",)], "tbl string")
    have = spark.createDataFrame([("k1", "en"), ("k1", "fr"), ("k2", "en"), ("old", "fr")], "key string, tbl string")
    assert rows(compare.key_coverage(keys, tables, have)) == [("k2", "fr", "missing"), ("old", "fr", "orphaned")]


def test_resolution_check(spark, rows):
    claims = [("F1", "c1", "t", "critical"), ("F2", "c9", "t", "critical"), ("F3", "c3", "c2", "Low"), ("F4", "t", "t", "Low"), ("F5", "c1", None, "Low"), ("F6", None, "t", "Low")]
    claims = spark.createDataFrame(claims, "finding string, commit string, tip string, severity string")
    # t merges c3 into c2, both after c1.
    parents = spark.createDataFrame([("t", "c2"), ("t", "c3"), ("c2", "c1"), ("c3", "c1"), ("c9", "c1")], "child string, parent string")
    assert rows(compare.resolution_check(claims, parents)) == [
        ("F1", "c1", "resolved", "discuss"), ("F2", "c9", "context only", "critical"), ("F3", "c3", "context only", "Low"), ("F4", "t", "resolved", "discuss"),
        ("F5", "c1", "unverified", "Low"), ("F6", None, "unverified", "Low"),
    ]
    assert set(rows(compare.resolution_check(claims, None), "state")) == {("unverified",)}
