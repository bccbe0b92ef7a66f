from __future__ import annotations

import numpy as np
import pytest

from plumbline.llm import vectors
from tests.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, h string, v double, key int"


def brute(rows, least=0.9):
    ok = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    links.append((i, j))
    comp = components(len(rows), links)
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    ids = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            ids[c] = min(ids.get(c, rows[i][0]), rows[i][0])
    return sorted(((r[0], int(n[i]), ids.get(comp[i])) for i, r in enumerate(rows)), key=repr)


def run(spark, rows, **k):
    found = vectors.link(spark.createDataFrame([(i, e, 1, "x", 0.5, 1) for i, e in rows], SCHEMA), **k).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr)


@pytest.mark.parametrize("block", [512, 7])
def test_planted_groups_copies_and_a_hot_group(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    centre = rng.normal(size=16)
    rows += [(100 + i, (centre + rng.normal(0, 0.12, 16)).tolist()) for i in range(70)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    assert run(spark, rows, block=block, recall=0.9999) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]),
        (8, [1.0]), (9, [2.0]), (10, [-1.0]), (11, [1e-30, 0.0]), (12, [1e30, 1e30]), (None, None), (1, None),
    ]
    assert run(spark, rows, recall=0.9999) == brute(rows)
    assert run(spark, []) == []


def test_recall_of_the_layout():
    rng = np.random.default_rng(4)
    for n in (100, 10_000, 10**8):
        bits, tables = vectors.layout(n)
        a = vectors.units(rng.normal(size=(300, 64)))
        b = rng.normal(size=a.shape)
        b = vectors.units(b - (b * a).sum(1, keepdims=True) * a)
        near = 0.9 * a + (1 - 0.81) ** 0.5 * b
        hit = (vectors.codes(a, bits, tables) == vectors.codes(near, bits, tables)).any(axis=1)
        assert hit.mean() > 0.97
