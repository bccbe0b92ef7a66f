from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from plumbline.catalog import changelog as catalog
from plumbline.operators import changelog, graph
from plumbline.plans import layout
from plumbline.plans.skew import salted_join


def log(spark, commits):
    return spark.createDataFrame([(i, f) for i, files in enumerate(commits) for f in files], "basket_id int, item string")


def fixture_commits():
    c = [["writer", "viewer", "types", "barrel", "driver", "follower"]]
    c += [["writer", "viewer"]] * 4 + [["writer", "types"]] * 4 + [["barrel", "viewer"]] * 4
    c += [["driver", "follower"]] * 3 + [["follower"]] * 3
    c += [["s2a", "s2b"]] * 2
    c += [["cfA", "cfB"]] * 3 + [["cfA"]] * 4 + [["cfB"]] * 4
    c += [["bulkA", "bulkB"] + [f"x{i}" for i in range(49)]] * 2
    return c


def test_hidden_coupling(spark, rows):
    pairs = changelog.co_change(log(spark, fixture_commits()))
    edges = spark.createDataFrame([("writer", "types")], "src string, dst string")
    hubs = spark.createDataFrame([("barrel",)], "item string")
    got = changelog.hidden_only(pairs, edges, hubs)
    assert rows(got, "driver", "follower", "support") == [("driver", "follower", 4), ("viewer", "writer", 5)]


def test_confidence_needs_half(spark, rows):
    got = changelog.co_change(log(spark, fixture_commits()), min_conf=0.0)
    conf = {(a, b): round(c, 4) for a, b, c in rows(got, "a", "b", "conf")}
    assert conf[("cfA", "cfB")] == round(3 / 7, 4)
    assert ("bulkA", "bulkB") not in conf and ("s2a", "s2b") not in conf


def test_tie_keeps_first(spark, rows):
    got = changelog.co_change(log(spark, [["b", "a"]] * 3))
    assert rows(got, "driver", "follower", "conf") == [("a", "b", 1.0)]


def test_adaptive_cap(spark):
    sizes = lambda *xs: spark.createDataFrame([(x,) for x in xs], "size bigint")
    cap = lambda s: changelog.adaptive_cap(s).first()[0]
    assert cap(sizes(*[2] * 50)) == 15
    assert cap(sizes(*[30] * 50)) == 30
    assert cap(sizes(*[500] * 50)) == 50


def test_churn_and_bus_factor(spark, rows):
    now = dt.datetime(2024, 6, 1)
    data = [("hot", "ann", now - dt.timedelta(days=i)) for i in range(4)] + [("hot", "bob", now)]
    data += [("old", "ann", now - dt.timedelta(days=181 + i)) for i in range(5)] + [("rare", "ann", now)] + [("two", "ann", now)] * 2
    df = spark.createDataFrame(data, "item string, actor string, ts timestamp")
    assert rows(changelog.churn(df)) == [("hot", 5), ("two", 2)]
    assert rows(changelog.bus_factor(df)) == [("hot", 5, 2, 0.8)]


def test_followups_against_brute_force(spark, rows):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    make = lambda n: [(rnd.choice("abc"), base + dt.timedelta(hours=rnd.randrange(24 * 200))) for _ in range(n)]
    p, f = make(60), make(12)
    p += [("z", base), ("z", base + dt.timedelta(days=1))]
    f += [("z", base + dt.timedelta(days=30))]
    frame = lambda d: spark.createDataFrame(d, "k string, ts timestamp")
    got = rows(changelog.followups(frame(p), frame(f), "k", minimum=1))
    span = dt.timedelta(days=30)
    want = []
    for k in sorted({k for k, _ in p}):
        ps = [t for kk, t in p if kk == k]
        hit = [t for t in ps if any(kk == k and t < x <= t + span for kk, x in f)]
        if hit:
            want.append((k, len(ps), len(hit)))
    assert got == want and ("z", 2, 2) in got


def test_ripple_groups_use_all_pairs(spark, rows):
    pairs = spark.createDataFrame(
        [("m/a", "m/b", 4), ("m/b", "n/c", 9), ("x/y", "x/z", 3), ("p/q", "p/r", 5)], "a string, b string, support bigint"
    )
    got = graph.ripple_groups(pairs)
    assert rows(got, "group_id", "node") == [("m/a", "m/a"), ("m/a", "m/b"), ("m/a", "n/c"), ("p/q", "p/q"), ("p/q", "p/r")]
    assert rows(graph.ripple_modules(got), "group_id", "size", "modules") == [("m/a", 3, 2), ("p/q", 2, 1)]


def test_salted_join_equals_plain_join(spark, rows):
    left = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 3 == 0).cast("int")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "zero"), (1, "one"), (9, "nine")], "k bigint, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(left, right, ["k"], how, buckets=8, min_rows=100)
        want = left.join(right, ["k"], how)
        assert rows(got.select(*want.columns)) == rows(want), how


def test_recent_changes_come_in_pieces_of_bounded_size(spark, tmp_path, monkeypatch):
    day = dt.date(2020, 1, 1)
    orders = [(i, day + dt.timedelta(days=i * 10)) for i in range(150)]
    lines = [(i, i * 7 % 11 + k) for i in range(150) for k in range(3)] + [(None, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(layout, "PIECE_ROWS", 25)
    found = catalog.recent_changes(spark, str(tmp_path))
    assert sorted((r.basket_id, r.item) for r in found.collect()) == sorted(x for x in lines if x[0] is not None and x[0] >= 59)
    assert found.rdd.getNumPartitions() == layout.pieces(len(lines)) == 19
    assert layout.pieces(10**9) == layout.MOST_PIECES
