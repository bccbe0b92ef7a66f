from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm, queries
from plumbline.llm.common import remainder
from tests.llm.common import awkward, tokens


def check(found, docs):
    counts, rows = Counter(), []
    for r in docs:
        own = [*tokens(r.text), 0]
        held = crc32(str(r.doc_id).encode()) % 10 == 0 if r.doc_id is not None else True
        rows.append((r.doc_id, held, own))
        if not held:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (repr(i), held, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), 4))
        for i, held, own in rows
    )
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found)
    assert len(want) == len(got)
    for a, b in zip(want, got, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6, abs=2e-4)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def rest(docs):
    return F.coalesce(remainder(F.col("doc_id"), 10), F.lit(0))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_base_scores_and_gain_on_held_out_texts(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 150_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = lm.score(docs, rest(docs), order=order).collect()
    check(found, docs.collect())
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) or order == 1


def test_probabilities_of_all_words_sum_to_one(spark):
    texts = ["a b a c", "b a", "c c a b", "a", "b c a a b"]
    docs = [(i, texts[i % 5], 1 + i % 9) for i in range(45)]
    vocabulary = ["a", "b", "c", "unseen"]
    docs += [(100 + i, w, 0) for i, w in enumerate(vocabulary)]
    docs += [(200, "", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, r int")
    found = {r.doc_id: r.score for r in lm.score(frame, F.col("r")).collect()}
    # After the beginning stands a word or the end: P(w) = P(w, end) / P(end | w), so words alone are summed by pairs.
    pairs = [(300 + 10 * i + j, f"{x} {y}", 0) for i, x in enumerate(vocabulary[:3]) for j, y in enumerate(vocabulary)]
    both = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs + pairs, "doc_id long, text string, r int"), F.col("r")).collect()}
    assert all(both[k] == pytest.approx(v) for k, v in found.items())
    assert 10 ** both[200] + sum(10 ** both[100 + i] for i in range(4)) < 1


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(lm.score(docs, rest(docs)).collect(), docs.collect())
    assert lm.score(docs.where("false"), rest(docs)).collect() == []
    alone = docs.where("doc_id is null")
    assert {(r.train_tokens, r.n_known) for r in lm.score(alone, rest(alone)).collect()} == {(0, 0)}


def test_query_learns_from_training_texts_only(spark):
    a = queries.QUERIES["op1_score_texts"](spark, "/root/testdata/sf0.001").where("held_out").count()
    assert 0 < a < 60
