from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import queries, whitening


@pytest.mark.parametrize("kind", ["falling", "clusters", "low rank", "one", "equal", "zero"])
def test_components_like_a_dense_solver(kind):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((48, 48)))
    values = {
        "falling": np.geomspace(1e4, 1e-2, 48), "clusters": np.repeat([9.0, 9.0 - 1e-6, 4.0, 1.0], 12),
        "low rank": np.r_[5.0, 3.0, np.zeros(46)], "one": np.ones(1), "equal": np.full(48, 3.0), "zero": np.zeros(48),
    }[kind]
    v = values[:1, None] if kind == "one" else q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    found, x = whitening.components(v, 8)
    want = np.sort(values)[::-1][:8]
    assert np.allclose(found, want, rtol=1e-12, atol=1e-11) and (np.diff(found) <= 0).all()
    assert np.abs(x.T @ x - np.eye(len(want))).max() < 1e-13
    assert np.abs(v @ x - x * found).max() <= 1e-12 * max(1, want[0])


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    values = np.r_[np.geomspace(1e-9, 1, 15), -np.geomspace(1e-7, 5, 15)]
    u = whitening.polar(q @ np.diag(values) @ q.T)
    assert np.abs(u - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-6
    assert np.abs(u @ u.T - np.eye(30)).max() < 1e-13


def brute(rows, wanted=8):
    """Per vector: deviation and whitened values, up to the components' signs; explained shares."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in usable], object)
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    v = np.array((away.T @ away) / n**3, float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    white = np.array(away / n, float) @ u / np.sqrt(e)
    return [(i, int((a**2).sum()), w) for (i, _), a, w in zip(usable, away, white, strict=True)], e / np.trace(v)


def held(found):
    out = {}
    for r in found:
        out.setdefault((repr(r.vec_id), int(r.deviation)), []).append((r.component, r.whitened))
    return out


def check(found, rows, wanted=8):
    want, explained = brute(rows, wanted)
    got = held(found)
    assert sum(len(x) for x in got.values()) == len(want) * len(explained)
    for i, deviation, white in want:
        mine = np.array([w for _, w in sorted(got[repr(i), deviation])]).reshape(len(white), -1)
        assert np.abs(mine - white[:, None]).max() < 1e-8
    for r in found:
        assert r.n == len(want) and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9


def test_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(queries.op11(spark, "/root/testdata/sf0.01").collect(), [(r.vec_id, r.embedding) for r in rows.collect()])


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(3) * (1, 50, 1e-2)]) for i in range(40)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, None), (90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 1.0]), (93, [1.0, -inf, 1.0])]
    schema = "vec_id long, embedding array<double>, n int, x string, w double, component string"
    frame = spark.createDataFrame([(i, v, 1, "x", 0.5, "c") for i, v in rows], schema)
    found = whitening.whiten(frame).collect()
    check(found, rows)
    # Vectors of another length, and none at all, are left out.
    more = frame.union(spark.createDataFrame([(95, [1.0, 2.0], 1, "x", 0.5, "c"), (96, [], 1, "x", 0.5, "c")], schema))
    assert held(whitening.whiten(more).collect()) == held(found)
    assert whitening.whiten(frame.where("false")).collect() == []
    for alike in (frame.where("vec_id = 5"), frame.where("vec_id = 0"), frame.where("vec_id in (90, 92)")):
        assert whitening.whiten(alike).collect() == []


def test_components_of_no_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [a := int(rng.integers(-99, 99)) / 8, -a, 2.5, b := int(rng.integers(-99, 99)) / 8, a + b]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in found} == {1, 2}
    check(found, rows, 2)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.uniform(-1, 1, 2) * 400_000]) for i in range(3000)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)
