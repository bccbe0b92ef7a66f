from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dag


def history(seed: int, n: int, merges: float, jump: int = 6):
    """Edges from later to earlier nodes: a parent close by, and a second one now and then."""
    rnd = random.Random(seed)
    out = set()
    for c in range(1, n):
        if rnd.random() < 0.05:
            continue
        out.add((c, max(0, c - rnd.randrange(1, jump))))
        while rnd.random() < merges:
            out.add((c, rnd.randrange(c)))
    return sorted(out)


def distances(pairs, tip):
    up = {}
    for c, p in pairs:
        up.setdefault(c, []).append(p)
    found, queue = {tip: 0}, deque([tip])
    while queue:
        x = queue.popleft()
        for p in up.get(x, ()):
            if p not in found:
                found[p] = found[x] + 1
                queue.append(p)
    return found


def depths(pairs):
    """Longest way down per node; None on and above cycles."""
    up, level = {}, {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
        up.setdefault(p, set())
    while free := [x for x in up if x not in level and all(p in level for p in up[x])]:
        level |= {x: max([level[p] + 1 for p in up[x]], default=0) for x in free}
    return {x: level.get(x) for x in up}


def frame(spark, pairs, names="child int, parent int"):
    return spark.createDataFrame(pairs, names)


def test_ancestry(spark, rows):
    # c1 <- c2 <- c3 <- c5, c2 <- c4, c5 merges c4
    parents = spark.createDataFrame(
        [("c2", "c1", 1), ("c3", "c2", 1), ("c4", "c2", 1), ("c5", "c3", 1), ("c5", "c4", 2)], "child string, parent string, n int"
    )
    pairs = spark.createDataFrame([("c1", "c5"), ("c4", "c3"), ("c9", "c9"), ("c9", "c1"), (None, "c1")], "a string, b string")
    assert rows(dag.is_ancestor(parents, pairs)) == [("c1", "c5", True), ("c4", "c3", False), ("c9", "c1", False), ("c9", "c9", True), (None, "c1", False)]
    assert rows(dag.commit_range(parents, spark.createDataFrame([("c5", "c2"), ("c4", "c3"), ("c2", "c2")], "a string, b string"))) == [
        ("c5", "c2", "c3"), ("c5", "c2", "c4"), ("c5", "c2", "c5"),
    ]
    assert rows(dag.merge_base(parents, spark.createDataFrame([("c3", "c4")], "a string, b string"))) == [("c3", "c4", "c2")]
    assert rows(dag.first_parent_chain(parents, spark.createDataFrame([("c5",)], "tip string")), "node") == [("c1",), ("c2",), ("c3",), ("c5",)]


@pytest.mark.parametrize("seed,n,merges,stretch", [(1, 60, 0.3, 256), (2, 90, 0.1, 3), (3, 40, 0.7, 2)])
def test_histories_with_merges_against_brute_force(spark, rows, monkeypatch, seed, n, merges, stretch):
    monkeypatch.setattr(dag, "STRETCH", stretch)
    pairs = history(seed, n, merges)
    graph = dag.labels(frame(spark, pairs))
    rnd = random.Random(seed)
    far = {x: distances(pairs, x) for x in range(n)}
    tips = rnd.sample(range(n), 8)
    got = rows(dag.ancestors(frame(spark, pairs), frame(spark, [(t,) for t in tips], "tip int"), graph=graph))
    assert got == sorted(((t, x, d) for t in tips for x, d in far[t].items()), key=repr)
    asked = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(150)]
    got = {(a, b): yes for a, b, yes in rows(dag.is_ancestor(None, frame(spark, asked, "a int, b int"), graph))}
    assert got == {(a, b): a in far[b] for a, b in asked}
    want = set()
    for a, b in asked[:40]:
        old, new = (a, b) if a in far[b] else (b, a)
        if old in far[new]:
            want |= {(a, b, x) for x in set(far[new]) - set(far[old])}
    assert set(rows(dag.commit_range(None, frame(spark, asked[:40], "a int, b int"), graph))) == want
    base = {}
    for a, b in asked[:20]:
        if common := set(far[a]) & set(far[b]):
            base[a, b] = min(common, key=lambda x: (far[a][x] + far[b][x], x))
    assert {(a, b): x for a, b, x in rows(dag.merge_base(None, frame(spark, asked[:20], "a int, b int"), graph))} == base


def test_questions_about_graphs_with_cycles(spark, rows):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (5, 6), (6, 7), (8, 5), (2, 7), (9, 9)]
    asked = [(a, b) for a in range(1, 10) for b in range(1, 10)]
    got = {(a, b): yes for a, b, yes in rows(dag.is_ancestor(frame(spark, pairs), frame(spark, asked, "a int, b int")))}
    assert got == {(a, b): a in distances(pairs, b) for a, b in asked}


def test_a_search_takes_a_round_per_change_of_path(spark, monkeypatch):
    # A trunk of 3000 with a branch merged at every tenth node, asked end to end.
    pairs = [(i, i - 1) for i in range(1, 3000)] + [e for i in range(10, 3000, 10) for e in ((i, 10_000 + i), (10_000 + i, i - 9))]
    graph = dag.labels(frame(spark, pairs))
    written = []
    monkeypatch.setattr(dag, "materialize", lambda df, name, keep=dag.materialize: (written.append(name), keep(df, name))[1])
    asked = frame(spark, [(0, 2999), (10_010, 2999), (12_990, 2999), (12_990, 2985), (2999, 0)], "a int, b int")
    got = {(r.a, r.b): r.is_ancestor for r in dag.is_ancestor(None, asked, graph).collect()}
    assert got == {(0, 2999): True, (10_010, 2999): True, (12_990, 2999): True, (12_990, 2985): False, (2999, 0): False}
    assert written.count("frontier") <= 5


def test_a_trunk_with_a_third_of_the_edges(spark):
    pairs = [(i, i - 1) for i in range(1, 1000)] + [(5000 + i, i % 1000) for i in range(2000)]
    asked = frame(spark, [(i % 1000, 5000 + (7 * i) % 2000) for i in range(3000)], "a int, b int")
    wrong = dag.is_ancestor(frame(spark, pairs), asked).where(F.expr("is_ancestor != (a <= (b - 5000) % 1000)"))
    assert wrong.count() == 0


def test_topo_levels(spark, rows):
    deps = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "node string, needs string")
    assert rows(dag.topo_levels(deps)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("x", None), ("y", None), ("z", None)]
    assert rows(dag.topo_levels(deps.where("false"))) == []


@pytest.mark.parametrize("seed", range(4))
def test_levels_against_brute_force(spark, rows, seed):
    rnd = random.Random(seed)
    pairs = history(seed, 70, 0.4 if seed % 2 else 0.05, 3)
    if seed > 1:
        pairs += [(rnd.randrange(20), rnd.randrange(70)) for _ in range(3)] + [(100, 101), (101, 102), (102, 100), (103, 100), (104, 104)]
    got = rows(dag.topo_levels(frame(spark, pairs + pairs[:5], "node int, needs int")))
    assert dict(got) == depths(pairs) and len(got) == len(dict(got))


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(dag, "materialize", lambda df, name, keep=dag.materialize: (written.append(name), keep(df, name))[1])
    chain = spark.range(1, 10_001).selectExpr("id as node", "id - 1 as needs").union(spark.range(1, 2000).selectExpr("id + 20000 as node", "id * 5 as needs"))
    assert dag.topo_levels(chain).where("level = if(node > 20000, (node - 20000) * 5 + 1, node)").count() == 12_000
    assert len(written) < 60


def test_linear_ancestors_send_nothing_through_the_driver(spark, monkeypatch):
    plans = []
    stored = dag.materialize

    def noted(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(dag, "materialize", noted)
    parents = spark.createDataFrame([(i, i + 1) for i in range(40)], "child long, parent long")
    tips = spark.createDataFrame([(0,), (30,), (99,)], "tip long")
    found = {(r.tip, r.node, r.depth) for r in dag.ancestors(parents, tips).collect()}
    assert found == {(0, i, i) for i in range(41)} | {(30, i, i - 30) for i in range(30, 41)} | {(99, 99, 0)}
    assert len(plans) > 5 and not any("BroadcastExchange" in p for p in plans)


def test_tips_that_have_ended_leave_the_rounds(spark, rows, monkeypatch):
    # One tip changes its path eight times, forty others do so once.
    places = [(i, i, 0, 10 - i) for i in range(9)] + [(1000 + i, 100, i, 1 + i) for i in range(40)] + [(2000, 101, 0, 0)]
    exits = [(i, 0, i + 1, 0, 9 - i) for i in range(8)] + [(100, 0, 101, 0, 0)]
    graph = dag.Labels(
        spark.createDataFrame(places, "node int, path int, at long, gen int"),
        spark.createDataFrame(exits, "path int, at long, path_to int, at_to long, gen_to int"),
    )
    kept = {}

    class Noted(dag.Accumulator):
        def add(self, rows):
            kept.setdefault(self._name, []).append(rows.select("tip").distinct().count())
            return super().add(rows)

    monkeypatch.setattr(dag, "Accumulator", Noted)
    tips = spark.createDataFrame([(0,), *[(1000 + i,) for i in range(40)]], "tip int")
    found = dag.reach(graph, tips.withColumn("floor", F.lit(None).cast("int")))
    others = [x for i in range(40) for x in ((1000 + i, 100, i), (1000 + i, 101, 0))]
    assert rows(found) == sorted([(0, i, 0) for i in range(9)] + others, key=repr)
    assert kept["going"][0] == 1
    down = {(r.tip, r.node): r.depth for r in dag.ancestors(None, tips, graph=graph).collect()}
    ways = {(1000 + i, 1000 + j): i - j for i in range(40) for j in range(i + 1)} | {(1000 + i, 2000): i + 1 for i in range(40)}
    assert down == {(0, i): i for i in range(9)} | ways
    assert 40 in kept["ended"]


def test_few_links_that_still_move_meet_the_ended_ones(spark, rows):
    # Many chains of two, one of a hundred, and a ring with a tail.
    ends = [(1000 + i, 5000) for i in range(600)] + [(i, i + 1) for i in range(100)] + [(700, 701), (701, 702), (702, 700), (703, 700)]
    links = spark.createDataFrame([(a, b, 1, 0) for a, b in ends], "node int, top int, w int, c int")
    got = rows(dag._followed(dag.materialize(links, "links")), "node", "top", "w", "open")
    assert [r for r in got if not r[3]] == sorted([(1000 + i, 5000, 1, False) for i in range(600)] + [(i, 100, 100 - i, False) for i in range(100)], key=repr)
    assert sorted(r[0] for r in got if r[3]) == [700, 701, 702, 703]
