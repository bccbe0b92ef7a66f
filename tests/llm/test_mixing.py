from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, queries
from tests.llm.common import awkward, tokens
from tests.oracle import compare, connect


def aims(sizes, weights=(5, 2, 1)):
    """Targets by the rule, sharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    want, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = want - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in order}
        full |= over


def check(found, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(tokens(r.text))
    target, taken = aims(dict(sizes)), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sorted((repr(r.doc_key), r.size) for r in found) == sorted((repr(r.doc_id), len(tokens(r.text))) for r in docs)


@pytest.mark.parametrize("block", [7, 4096])
def test_targets_are_met(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    found = mixing.mix(docs, F.col("doc_id"), block=block).collect()
    check(found, docs.collect())
    assert sorted(found) == sorted(mixing.mix(docs.repartition(5), F.col("doc_id"), block=block).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(mixing.mix(docs, F.col("doc_id")).collect(), docs.collect())
    assert mixing.mix(docs.where("false"), F.col("doc_id")).collect() == []
    empty = docs.where("doc_id in (2, 3)")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(empty, F.col("doc_id")).collect()} == {(0, 0.0, 0)}


def test_the_schedule_spreads_each_source(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', 10) text", "concat('s', id % 3) source")
    placed = mixing.shuffled(docs, F.col("doc_id"), F.lit(10))
    plan = mixing.targets(placed.groupBy("sk").agg(F.sum("size").alias("source_size")))
    slots = sorted((r.slot, r.sk, r["rank"], r.words) for r in mixing.schedule(plan, 100).collect())
    by = defaultdict(list)
    for slot, sk, rank, words in slots:
        by[sk].append((slot, rank, words))
    share = {r.sk: r.target / 45_000 for r in plan.collect()}
    for sk, own in by.items():
        assert [r for _, r, _ in own] == list(range(len(own))) and abs(sum(w for *_, w in own) - 45_000 * share[sk]) <= 1
        for i, (slot, *_) in enumerate(own):
            assert abs(i - slot * share[sk]) < 6 or slot >= 440


def test_sql_agrees(spark):
    con = connect("/root/testdata/sf0.001")
    for name in ("op9_mix", "op7_filter_urls"):
        assert compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con, queries.SQL[name]) == []
