from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import conformance, graph, predicates, profile, quality, references, verdicts


def corpus(spark, sizes):
    return spark.createDataFrame([(k, v) for k, v in sizes.items()], "doc_id string, loc bigint")


def test_size_profile_interpolates_then_rounds(spark):
    got = profile.size_profile(corpus(spark, {"a": 10, "b": 20, "c": 31, "d": 400})).first()
    # median (20 + 31) / 2 = 25.5 -> 26; p90 = 31 + 0.7 * 369 = 289.3 -> 289
    assert tuple(got) == (4, 461, 26, 289)


def test_size_profile_of_nothing(spark):
    assert tuple(profile.size_profile(corpus(spark, {"a": 1}).where("loc > 5")).first()) == (0, 0, 0, 0)


def test_size_outliers(spark, rows):
    sizes = {f"d{i}": 10 for i in range(20)} | {"big": 100, "edge": 30}
    assert rows(profile.size_outliers(corpus(spark, sizes))) == [("big", 100, 10.0)]


def test_single_document_uses_absolute_limit(spark, rows):
    one = spark.createDataFrame([("a", 350, "py")], "doc_id string, loc bigint, lang string")
    assert rows(profile.size_outliers(one, language="lang"), "doc_id") == [("a",)]
    assert rows(profile.size_outliers(one.withColumn("lang", F.lit("java")), language="lang"), "doc_id") == []


def test_categories_count_all_matching_rules(spark):
    text = "import x from 'react'\nimport 'node:fs'\nconst y = require('@app/db/redis')\nawait import('jsonwebtoken')\nimport z from './local'"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(profile.specifiers(F.col("t")).alias("s"), profile.categories(profile.specifiers(F.col("t"))).alias("c")).first()
    assert sorted(got["s"]) == sorted(["react", "node:fs", "@app/db/redis", "jsonwebtoken", "./local"])
    assert got["c"] == ["auth", "fs-io", "persistence", "ui"]


def test_god_docs_reasons(spark, rows):
    base = [(f"n{i}", 10, 0, 1.0) for i in range(100)]
    cases = [("mixing", 10, 4, 1.0), ("both", 500, 5, 0.1), ("frag", 500, 0, 0.1), ("unmeasured", 500, 0, None), ("rescued", 500, 0, 0.9)]
    df = spark.createDataFrame(base + cases, "doc_id string, loc bigint, cats bigint, cohesion double")
    assert rows(profile.god_docs(df), "doc_id", "reason") == [
        ("both", "mixing+size"), ("frag", "size+low-cohesion"), ("mixing", "mixing"), ("unmeasured", "size"),
    ]


def test_cohesion_islands(spark, rows):
    cohesive = "function a() { return b() }\nfunction b() { return c }\nconst c = 1\n"
    split = "function a() {}\nfunction b() {}\nconst c = () => a()\nclass D {}\n"
    df = spark.createDataFrame([("x", cohesive), ("y", split), ("z", "const one = 1"), ("e", "")], "doc_id string, text string")
    got = rows(graph.cohesion(df), "doc", "symbols", "behavioral", "components", F.round("cohesion", 3))
    assert got == [("e", 0, 0, 0, None), ("x", 3, 2, 1, 1.0), ("y", 4, 4, 3, 0.333), ("z", 1, 0, 1, None)]


def test_barrels(spark, rows):
    df = spark.createDataFrame(
        [("b", "export * from './a'\nexport type X = 1"), ("i", "export { y } from './a'\nexport function f() {}"), ("t", "export const K = 1")],
        "doc_id string, text string",
    )
    assert rows(graph.barrels(df, graph.symbols(df))) == [("b",)]


def test_swallowed_failures(spark):
    text = "try { a() } catch (e) {}\ntry { b() } catch { // nothing\n}\ntry { c() } catch (e) { log(e) }\np.catch(() => {})\nq.catch(function (e) { })"
    df = spark.createDataFrame([("a", text), ("b", "try {} catch (e) { throw e }")], "doc_id string, text string")
    got = profile.marker_count(df, [profile.EMPTY_CATCH_RE, profile.EMPTY_PROMISE_CATCH_RE]).select("doc_id", "markers").collect()
    # The function handler counts under both patterns.
    assert [tuple(r) for r in got] == [("a", 5)]


def test_test_density(spark, rows):
    df = spark.createDataFrame(
        [("thin", "it('a', () => {}); it('b', () => {}); expect(1)"), ("good", "test('a', () => { expect(1).toBe(1) })"), ("none", "expect(1)")],
        "doc_id string, text string",
    )
    assert rows(profile.marker_density(df, profile.TEST_CASE_RE, profile.ASSERT_RE), "doc_id", "a", "b", "ratio") == [("thin", 2, 1, 0.5)]


def test_write_sites_nearest_marker_and_alias(spark, rows):
    text = (
        'const T = "entries";\ndb.from(T).insert(x);\ndb.from("plans").select();\n' + " " * 500 + "thing.update(1);\n"
        'db.from("plans").update(y);\ndb.from(OTHER).delete();\ndb.rpc("grant");'
    )
    df = spark.createDataFrame([("a", text), ("b", 'db.from("plans").insert(z)')], "path string, text string")
    assert rows(profile.write_sites(df)) == [
        ("a", "rpc:grant"), ("a", "table:OTHER"), ("a", "table:entries"), ("a", "table:plans"), ("b", "table:plans"),
    ]


def test_nearest_preceding_gap_and_blocks(spark, rows):
    m = spark.createDataFrame([("k", 0, "zero"), ("k", 399, "late"), ("k", 1200, "far"), ("j", 5, "other")], "k string, pos bigint, label string")
    c = spark.createDataFrame([("k", p) for p in (0, 1, 399, 400, 798, 799, 1201, 1600)], "k string, pos bigint")
    got = profile.nearest_preceding(m, c, ["k"], "pos", "label", 400)
    assert rows(got, "pos", "label") == [(0, None), (1, "zero"), (1201, "far"), (1600, None), (399, "zero"), (400, "late"), (798, "late"), (799, None)]


def test_nearest_preceding_of_a_key_in_many_ranges(spark, rows):
    rnd = random.Random(4)
    mark = [(None if k == 3 else k, rnd.randrange(3000), f"m{rnd.randrange(99)}") for k in (0, 0, 0, 1, 2, 3) for _ in range(150)]
    call = [(None if k == 3 else k, rnd.randrange(3000) if k else rnd.choice([7, 1500, rnd.randrange(3000)]), i) for i, k in enumerate([0, 0, 0, 0, 1, 3] * 300)]
    m = spark.createDataFrame(mark, "k int, pos bigint, label string").repartition(8)
    c = spark.createDataFrame(call, "k int, pos bigint, id int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {i: label for _, _, i, label in rows(profile.nearest_preceding(m, c, ["k"], "pos", "label", 40))}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, p, i in call:
        before = [(q, label) for j, q, label in mark if j == k and q < p]
        at, label = max(before, default=(None, None))
        want[i] = label if before and p - at < 40 else None
    assert got == want and sum(v is None for v in want.values()) > 20


def test_usage_unknown_inbound(spark, rows):
    df = spark.createDataFrame(
        [("a", "alpha uses beta"), ("b", "beta alone"), ("c", "beta and alpha"), ("d", "x")], "doc_id string, text string"
    )
    stem = F.when(F.col("doc_id") == "a", "alpha").when(F.col("doc_id") == "b", "beta")
    got = profile.usage(df, F.lit(5), stem, tx.words(F.col("text")))
    assert rows(got, "doc_id", "inbound") == [("a", 1), ("b", 2), ("c", None), ("d", None)]


def test_usage_by_text_cuts_at_what_no_stem_holds(spark, rows):
    texts = ["<p>alpha-beta</p> é\u00e4x [a]^\\b", "alphabeta al 12alpha3", "a-b éä \U0001f600z", "", None, "ALPHA al\tpha x^\\by", "al-pha pha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for stems in (["alpha", "beta", None, "pha"], ["a-b", "éä", "^\\b", "]", "\U0001f600z", "al pha", "", "a"], ["p>", "12"], [None], [""]):
        wanted = spark.createDataFrame([(i % 7, s) for i, s in enumerate(stems)], "doc_id long, stem string")
        got = profile.usage_by_text(docs, wanted)
        # Where a stem is found is stored once; the texts aren't cut again for each of its uses.
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        held = lambda s, t: bool(s and t) and " " not in s and s in t
        expected = [(i % 7, s, None if s is None else sum(held(s, t) for d, t in enumerate(texts) if d != i % 7)) for i, s in enumerate(stems)]
        assert rows(got) == sorted(expected, key=repr), stems


def test_shape_conflicts(spark, rows):
    df = spark.createDataFrame(
        [("A", ["x", "y", "z"]), ("A", ["x", "y"]), ("A", ["x", "y", "w"]), ("B", ["z", "y", "x"]), ("C", ["p", "q", "r"])],
        "name string, fields array<string>",
    )
    assert rows(profile.shape_conflicts(df)) == [("drift", "A", 2, 2), ("same-shape", "x;y;z", 2, 2)]


def test_prefix_cluster(spark, rows):
    df = spark.createDataFrame([("a/b/x",), ("a/b/y",), ("a/c/z",), ("q",), ("r/s/t",)], "path string")
    assert rows(profile.prefix_cluster(df)) == [("a/b/x", "a/b", 2), ("a/b/y", "a/b", 2), ("a/c/z", "a", 3), ("q", "q", 1), ("r/s/t", "r/s/t", 1)]


def test_role_tag_first_match(spark, rows):
    df = spark.createDataFrame([("db/schema/x.test.ts", 9), ("a/x.spec.ts", 9), ("package.json", 0), ("hub.ts", 3), ("plain.ts", 2)], "path string, n int")
    got = predicates.role_tag(df, consumers=F.col("n"))
    assert rows(got, "path", "role") == [
        ("a/x.spec.ts", "test"), ("db/schema/x.test.ts", "persistence"), ("hub.ts", "hub"), ("package.json", "config"), ("plain.ts", "code"),
    ]


def test_sink_rules(spark, rows):
    text = "exec('ls')\nfetch(url)\nfetch('https://a')\nconst API_KEY = 'abcdefghijklmnop'\nreadFile(base + name)\nok()"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert rows(predicates.pattern_scan(df, predicates.SINK_RULES), "line_no", "rule") == [
        (1, "command-exec"), (2, "ssrf"), (4, "secrets-in-diff"), (5, "path-traversal"),
    ]


def test_lint(spark, rows):
    good = "---\n" + "".join(f"{k}: v\n" for k in predicates.CORE_FIELDS[:-1]) + "status: ready\n---\nfine `{x}` ${y}\n```\ncode TODO\n```\n"
    bad = "---\nstatus: ready\nparent: gone.md\ncontent_hash: 00\n---\nTODO and {name}\n```ts\n\n```\n"
    draft = "---\nstatus: draft\n---\n{name}"
    df = spark.createDataFrame([("a/artifacts/plan/g.md", good), ("a/artifacts/discover/b.md", bad), ("x.md", draft)], "path string, text string")
    got = predicates.doc_lint(df, universe=df.select("path"))
    by = {}
    for p, *e in rows(got):
        by.setdefault(p, []).append(tuple(e))
    assert "a/artifacts/plan/g.md" not in by
    assert {("open_token", None, "{name}"), ("placeholder", None, "TODO"), ("empty_fence", None, "ts"), ("lost", "parent", "gone.md"),
            ("empty", "topic", None), ("stale", "content_hash", "00")} <= set(by["a/artifacts/discover/b.md"])
    assert {e[0] for e in by["x.md"]} == {"empty"}


def test_lint_reads_a_text_once(spark, rows):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(n):
        reads.add(1)
        return f"---\nparent: {n + 3}\nparent: {n + 2}\n---\nTODO"

    df = spark.range(4).select(F.col("id").cast("string").alias("path"), read("id").alias("text"))
    got = predicates.doc_lint(df, universe=spark.range(4).select(F.col("id").cast("string").alias("path")))
    assert [r for r in rows(got, "path", "code", "value") if r[1] == "lost"] == [("2", "lost", "4"), ("3", "lost", "5")]
    assert reads.value == 4


def test_commit_sections(spark, rows):
    data = [("feat!: new api", None), ("fix(core): bug", None), ("test: x", None), ("chore(release): v1.2.3", None), ("1.2.3", None), ("docs: y", "a\nBREAKING CHANGE: z"), ("no type", None)]
    df = spark.createDataFrame(data, "subject string, body string")
    assert rows(predicates.conventional_commit(df, body="body"), "subject", "section") == [
        ("docs: y", "Breaking / Upgrade Notes"), ("docs: y", "Changed"), ("feat!: new api", "Added"), ("feat!: new api", "Breaking / Upgrade Notes"), ("fix(core): bug", "Fixed"),
    ]


def test_coverage_and_mutation(spark, rows):
    hits = spark.createDataFrame(
        [("a", "stmt", 1), ("a", "stmt", 0), ("a", "branch", 0), ("b", "stmt", 2)], "path string, kind string, hit int"
    )
    assert rows(quality.coverage_rollup(hits)) == [("a", 50, 0, 100), ("b", 100, 100, 100), (None, 67, 0, 100)]
    m = spark.createDataFrame(
        [("a", s) for s in ("Killed", "Killed", "Survived", "NoCoverage")] + [("b", "RuntimeError"), ("c", "Timeout")], "path string, status string"
    )
    assert rows(quality.mutation_score(m)) == [("a", 2, 1, 1, 0, 67), ("c", 0, 0, 0, 1, 0), (None, 2, 1, 1, 1, 67)]


def test_report_scope(spark):
    target = spark.createDataFrame([("lib/a",), ("lib/b",)], "path string")
    rep = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    scope = lambda r, t="lib": tuple(quality.report_scope(target, r, t).first())
    assert scope(rep("lib/a", "lib/b")) == (2, 2, 0, "partial")
    assert scope(rep("lib/a", "x/1", "x/2", "x/3")) == (2, 1, 1, "full")
    assert scope(rep("lib/a", "x/1", "y/1")) == (2, 1, 1, "full")
    assert scope(rep("lib/a", "x/1")) == (2, 1, 1, "partial")
    assert scope(rep("lib/a"), ".") == (2, 1, 1, "detected")


def test_theater_matrix(spark, rows):
    d = spark.createDataFrame([("real", 1.0), ("thin", 0.2), ("def", 2.0), ("mock", 1.0), ("unk", 1.0)], "path string, ratio double")
    c = spark.createDataFrame([("real", 90, 80), ("thin", 90, 80), ("def", 90, 80), ("gap", 90, 0), ("unk", 50, 50)], "path string, stmt int, branch int")
    m = spark.createDataFrame([("real", 95), ("def", 39), ("thin", 95)], "path string, score int")
    assert rows(quality.theater_matrix(d, c, m, "partial"), "path", "verdict") == [
        ("def", "definitive theater"), ("gap", "coverage gap"), ("mock", "mock theater"), ("real", "real"), ("thin", "theater"), ("unk", "unknown"),
    ]


def blocks(spark, **labels):
    data = [(k.replace("_", "-"), line) for k, lines in labels.items() for line in (lines or [None])]
    return spark.createDataFrame(data, "label string, line string")


def test_warrant_predicates_and_bands(spark):
    run = lambda n, pre=False, **b: verdicts.warrant(blocks(spark, **b), F.lit(n), pre).first()
    fe = run(40, feature_envy_candidates=["a\tenvies=x\text=9\town=3\tratio=0.75"])
    assert (fe["live"], fe["band"], fe["dispatch"]) == (["Fe"], "selective", ["Fe", "M", "L"])
    assert run(40, feature_envy_candidates=["a\text=9\town=3\tratio=0.69"])["band"] == "skip"
    assert run(40, dup_candidates=["a | b\tvia=structural"])["live"] == []
    assert run(40, dup_candidates=["a | b\tvia=structural"] * 3)["live"] == ["D"]
    assert run(258, low_cohesion=[])["band"] == "full"
    assert run(10, True, low_cohesion=[])["band"] == "full"
    assert run(10, type_fragmentation_semantic=[])["unmeasured"] == []
    assert run(10, low_cohesion=[])["unmeasured"] == ["C"]
    assert run(10, export_usage=["a\texports=9\tinbound=0"])["live"] == ["A"]
    assert run(10, export_usage=["a\texports=9\tinbound=0"], dead_exports_semantic=[])["live"] == []
    assert run(10, catch_swallows=["a\tswallows=1"])["live"] == []
    assert run(10, catch_swallows=["a\tswallows=3"])["live"] == ["Fp"]
    assert run(10, co_change_groups=["g1\tfiles=a, b"])["live"] == []
    assert run(10, co_change_groups=["g1\tfiles=a, b, c"])["live"] == ["Tc"]


def test_gate_skips_unknown(spark, rows):
    c = spark.createDataFrame([(3, None)], "u bigint, a bigint")
    assert rows(conformance.threshold_gate(c, {"u": 2, "a": 5}), "measure", "verdict") == [("a", "skip"), ("u", "fail")]


def test_envy(spark, rows):
    envious = "import { helper } from './other'\n" + "helper.go()\n" * 6 + "function mine() {}\nmine()"
    balanced = "import { helper } from './other'\n" + "helper.go()\n" * 5 + "function mine() {}\n" + "mine()\n" * 9
    vendor = "import { lib } from 'vendor'\n" + "lib.go()\n" * 9
    typed = "import type { T } from './types'\n" + "T.x()\n" * 9
    docs = spark.createDataFrame([("e", envious), ("b", balanced), ("v", vendor), ("t", typed)], "doc_id string, text string")
    refs = references.behavioural_refs(docs)
    own = graph.symbols(docs).select("doc", "name")
    got = references.envy(refs, references.import_bindings(docs, "doc_id"), own)
    # A declaration such as ``function mine()`` is itself followed by a parenthesis and counts.
    assert rows(got, "doc", "module", "ext", "own") == [("e", "./other", 6, 2)]
