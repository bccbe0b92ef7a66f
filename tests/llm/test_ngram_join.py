from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ngram_join
from tests.llm.common import awkward, components, tokens

SCHEMA = "doc_id long, text string, n int, fp string"


def shingle_set(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    comp = components(len(rows), links)
    ids = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            ids[c] = min(ids.get(c, rows[i][0]), rows[i][0])
    return Counter((r[0], len(sets[i]), r[0] if not sets[i] else ids.get(comp[i])) for i, r in enumerate(rows))


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())


def near(rng, words, rate):
    return [rng.choice("uvwxyz") * rng.randint(1, 9) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("all_frequent", [False, True])
def test_links_like_brute_force(spark, monkeypatch, all_frequent):
    if all_frequent:
        # Every token in the frequent class: only combinations are signatures.
        monkeypatch.setattr(ngram_join, "frequent_slots", lambda d, counters: np.ones(counters, bool))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    rows, shared = [], [word() for _ in range(60)]
    for i in range(70):
        base = [word() for _ in range(rng.choice([3, 6, 8, 12, 20, 90, 300]))]
        if rng.random() < 0.5:
            base = base + shared
        rows.append((i, " ".join(base)))
        for k in range(rng.randint(0, 3)):
            rows.append((1000 + 10 * i + k, " ".join(near(rng, base, rng.choice([0, 0.01, 0.03, 0.05])))))
    hot = [word() for _ in range(120)]
    rows += [(5000 + i, " ".join(near(rng, hot, 0.02))) for i in range(60)]
    rows += [(7000 + i, " ".join(hot[:-1] + [word()])) for i in range(25)] + [(8000 + i, " ".join(hot)) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        pool = rng.integers(0, 2**63, n + 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        x = pool[:n]
        drop = int(rng.integers(0, n // 8 + 1))
        y = np.concatenate([pool[drop:n], pool[n : n + int(rng.integers(0, n // 8 + 1))]])
        frequent = set(rng.choice(pool, int(rng.integers(0, len(pool) + 1)), replace=False).tolist())
        both = []
        for s in (np.unique(x), np.unique(y)):
            late = np.array([t in frequent for t in s.tolist()], bool)
            rare, need = s[~late], len(s) // 4 + 1
            found = {int(t): len(s) - i for i, t in enumerate(rare[:need])}
            if len(rare) < need:
                for sig, left in ngram_join.frequent_signatures(len(rare), s[late], len(s), need):
                    for a, b in zip(sig.tolist(), left.tolist(), strict=True):
                        found[a] = max(found.get(a, 0), b)
            both.append((len(s), found))
        overlap = len(np.intersect1d(x, y))
        sizes = both[0][0] + both[1][0]
        if 7 * overlap >= 3 * sizes:
            common = both[0][1].keys() & both[1][1].keys()
            assert common and max(min(both[0][1][c], both[1][1][c]) for c in common) >= overlap


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()) == brute(rows)
    assert ngram_join.join(docs.where("false")).collect() == []
    assert run(spark, [(None, "a b c d e f"), (None, "a b c d e f")]) == Counter({(None, 2, None): 2})
