from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import conformance, graph, references

EDGES = [
    ("ui/a.ts", "core/x.ts"), ("ui/a.ts", "core/y.ts"), ("ui/b.ts", "core/x.ts"), ("core/x.ts", "flux/f.ts"),
    ("flux/f.ts", "helpers/h1.ts"), ("flux/f.ts", "helpers/h2.ts"), ("cyc/p.ts", "cyc/q.ts"), ("cyc/q.ts", "cyc/p.ts"),
    ("cyc2/r.ts", "cyc2/s.ts"), ("cyc2/s.ts", "cyc2/t.ts"), ("cyc2/t.ts", "cyc2/r.ts"),
]


def edges(spark, pairs=EDGES):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_instability(spark, rows):
    got = {r[0]: r[1:] for r in rows(graph.instability(edges(spark)).withColumn("instability", F.round("instability", 2)))}
    assert got["core"] == (2, 1, 2, 0.33)
    assert got["flux"] == (1, 2, 1, 0.67)
    assert got["ui"] == (0, 2, 2, 1.0)
    assert rows(graph.instability(edges(spark), target="core"), "folder", "ca", "ce") == [("core", 2, 1)]


def test_sdp(spark, rows):
    got = graph.sdp_violations(edges(spark)).select("src_folder", "dst_folder", F.round("delta", 2), "edges", "sample")
    assert rows(got) == [("core", "flux", 0.33, 1, "core/x.ts -> flux/f.ts")]
    assert rows(graph.sdp_violations(edges(spark), target="helpers"), "src_folder") == []
    weak = edges(spark, [("app/m.ts", "svc/s.ts"), ("app/m.ts", "util/h.ts"), ("svc/s.ts", "util/h.ts"), ("svc/s.ts", "domain/d.ts"), ("util/h.ts", "svc/s.ts")])
    assert rows(graph.sdp_violations(weak)) == []
    assert rows(graph.sdp_violations(weak, 0.1), "src_folder", "dst_folder") == [("util", "svc")]


def test_cycles(spark, rows):
    got = graph.cycles(edges(spark)).orderBy(F.col("size").desc()).select("size", "path").collect()
    assert [tuple(r) for r in got] == [(3, "cyc2/r.ts -> cyc2/s.ts -> cyc2/t.ts -> cyc2/r.ts"), (2, "cyc/p.ts -> cyc/q.ts -> cyc/p.ts")]
    assert rows(graph.cycles(edges(spark), target="core")) == []
    assert rows(graph.cycles(edges(spark, [("a", "b"), ("b", "c")]))) == []


def test_volatile_hubs(spark, rows):
    churn = spark.createDataFrame([("core/x.ts", 5), ("helpers/h1.ts", 7), ("cyc/p.ts", 1)], "item string, commits bigint")
    assert rows(graph.volatile_hubs(churn, edges(spark))) == [("core/x.ts", 5, 2, 10)]


def test_components_of_a_long_path_and_a_star(spark, rows):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(100)]
    star = [("hub", f"leaf{i}") for i in range(60)]
    random.Random(1).shuffle(path)
    df = spark.createDataFrame(path + star + [("solo", "solo")], "a string, b string")
    got = graph.connected_components(df).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    assert rows(got) == [("hub", 61), ("p000", 101)]


def test_components_round_limit_raises(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(graph.NotConverged):
        graph.connected_components(path, max_rounds=1)


def brute_scc(pairs):
    nodes = {x for e in pairs for x in e}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            new = set().union(reach[n], *[reach[m] for m in reach[n]])
            if new != reach[n]:
                reach[n], changed = new, True
    return {frozenset(m for m in reach[n] if n in reach[m]) | {n} for n in nodes if n in reach[n] and any(m != n and n in reach[m] for m in reach[n])}


def test_strongly_connected_against_brute_force(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(24), rnd.randrange(24)) for _ in range(34)]
    got = {}
    for node, scc in graph.strongly_connected(spark.createDataFrame(pairs, "src int, dst int")).collect():
        got.setdefault(scc, set()).add(node)
    assert {frozenset(v) for v in got.values()} == brute_scc(pairs)


def test_conformance(spark, rows):
    elements = spark.createDataFrame([("app.ui", ["ui"]), ("app.core", ["core"]), ("lib", ["flux", "helpers/h1.ts:12"])], "fqn string, prefixes array<string>")
    relations = spark.createDataFrame([("app", "lib", "uses"), ("app.ui", "app.core", "calls"), ("lib", "app.ui", "wish")], "src string, dst string, title string")
    prefixes = conformance.element_prefixes(elements)
    mapped = conformance.map_edges(edges(spark), prefixes)
    credits = conformance.credited(conformance.owner_pairs(mapped), relations)
    assert rows(conformance.undocumented(credits)) == []
    assert rows(conformance.aspirational(relations, credits, prefixes)) == [("lib", "app.ui", "wish")]
    assert ("helpers/h2.ts",) in rows(conformance.unmapped(mapped))
    summary = conformance.conformance_summary(edges(spark), elements, relations.where("src <> 'app.ui'"))
    assert tuple(summary.first()) == (1, 1, 6, "ok")
    empty = conformance.conformance_summary(edges(spark).where("false"), elements, relations).first()
    assert empty["status"] == "degraded" and empty["undocumented"] is None


def test_nearest_relation_gets_the_credit(spark, rows):
    pairs = spark.createDataFrame([("a.x", "b.y", 1, "")], "a string, b string, n bigint, sample string")
    rel = spark.createDataFrame([("a", "b"), ("a", "b.y"), ("a.x", "b")], "src string, dst string")
    assert rows(conformance.credited(pairs, rel), "credit_src", "credit_dst") == [("a.x", "b")]


def test_layers(spark, rows):
    e = edges(spark, [("dom/a.ts", "app/b.ts"), ("app/b.ts", "dom/a.ts"), ("app/x.test.ts", "dom/a.ts"), ("infra/i.ts", "app/b.ts"), ("dom/a.ts", "infra/i.ts"), ("domain/q.ts", "app/b.ts")])
    got = conformance.layer_breaches(e, [("domain", ["dom"]), ("app", ["app"]), ("infra", ["infra"])], [("dom", "infra")])
    assert rows(got) == [("app/b.ts", "dom/a.ts", "no-upward-l1"), ("dom/a.ts", "infra/i.ts", "boundary-1"), ("infra/i.ts", "app/b.ts", "no-upward-l2")]


def test_resolve_reference(spark, rows):
    files = spark.createDataFrame([(p,) for p in ("a/b.ts", "a/c/index.tsx", "a/c.js", "lib/u.ts", "app/v.mts", "root.ts")], "path string")
    refs = spark.createDataFrame(
        [("a/x.ts", s) for s in ("./b", "./c", "../root", "@lib/u", "@app/v", "@/a/b.ts", "react", "./missing")], "src string, spec string"
    )
    got = dict(rows(references.resolve_reference(refs, files), "spec", "dst"))
    assert got == {"./b": "a/b.ts", "./c": "a/c.js", "../root": "root.ts", "@lib/u": "lib/u.ts", "@app/v": "app/v.mts", "@/a/b.ts": "a/b.ts", "react": None, "./missing": None}


def test_resolve_path(spark, rows):
    files = spark.createDataFrame([(p,) for p in ("lib/a.ts", "x/lib/a.ts", "lib/b.ts", "c.ts", "y/c.ts")], "path string")
    cites = spark.createDataFrame([(t,) for t in ("lib/a.ts", "a.ts", "b.ts", "./lib/b.ts", "c.ts", "zz.ts", "ib/b.ts")], "tok string")
    got = {t: (r, why) for t, r, why in rows(references.resolve_path(cites, files))}
    assert got == {
        "lib/a.ts": ("lib/a.ts", None), "a.ts": (None, "ambiguous: 2 matches"), "b.ts": ("lib/b.ts", None), "./lib/b.ts": ("lib/b.ts", None),
        "c.ts": ("c.ts", None), "zz.ts": (None, "no such file"), "ib/b.ts": (None, "no such file"),
    }
    assert rows(references.ambiguous_names(cites, files)) == [("a.ts", 2), ("c.ts", 2)]


def test_dead_and_dangling(spark, rows):
    defs = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "h")], "doc string, name string")
    refs = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "zz")], "doc string, name string")
    assert rows(references.dead_definitions(defs, refs), "doc", "name") == [("a", "f"), ("b", "h")]
    assert rows(references.dangling(refs, defs), "name") == [("zz",)]
    assert rows(references.orphans(defs, refs), "name") == [("h",)]
    text = spark.createDataFrame([(1, "subagent: plugin:alpha\nsubagent: beta ignore-me\nsubagent: gamma")], "doc_id int, text string")
    assert rows(references.reference_tokens(text, r"subagent:\s*([A-Za-z][\w:-]*)", ignore="ignore-me"), "name") == [("alpha",), ("gamma",)]


def test_lookup_near_path(spark, rows):
    files = spark.createDataFrame([(p,) for p in ("lib/gen/v.ts", "app/gen/v.ts", "xlib/q/v.ts", "one/u.ts", "a/w.ts", "b/w.ts")], "path string")
    cites = spark.createDataFrame([(t,) for t in ("lib/gen/v.ts", "app/v.ts", "q/v.ts", "zz/u.ts", "w.ts", "lib/q/v.ts", "en/v.ts", "no.ts")], "tok string")
    got = {t: (r, h) for t, r, h in rows(references.lookup_near_path(cites, files))}
    assert got == {
        "lib/gen/v.ts": ("lib/gen/v.ts", "exact"), "app/v.ts": ("app/gen/v.ts", "name+folder"), "q/v.ts": ("xlib/q/v.ts", "suffix"),
        "zz/u.ts": ("one/u.ts", "name"), "w.ts": ("a/w.ts", "first"), "lib/q/v.ts": ("xlib/q/v.ts", "name+folder"), "en/v.ts": ("app/gen/v.ts", "first"), "no.ts": (None, None),
    }


def test_named_nodes_are_compared_as_numbers(spark, rows, monkeypatch):
    kinds = []
    monkeypatch.setattr(graph, "materialize", lambda df, name, keep=graph.materialize: (kinds.append((name, df.schema)), keep(df, name))[1])
    pairs = [("b", "a"), ("a", "b"), ("b", "c10"), ("c10", "c9"), ("c9", "c10"), ("d", "d"), ("c9", "e"), (None, "a"), ("c9", None), ("b", "a")]
    got = graph.strongly_connected(spark.createDataFrame(pairs, "src string, dst string"))
    assert rows(got, "node", "scc") == [("a", "b"), ("b", "b"), ("c10", "c9"), ("c9", "c9")]
    colors = [s["color"].dataType.typeName() for name, s in kinds if name == "color"]
    assert colors and set(colors) == {"long"}
