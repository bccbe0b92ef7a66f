from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import line_rules, queries
from tests.llm.common import WORD, awkward


def base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(runs)
    marked = {j for i, r in enumerate(runs) if seen[r] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n


def check(docs, found):
    want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert want == got


def test_base_counts_and_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.QUERIES["op2_line_rules"](spark, "/root/testdata/sf0.01").cache()
    check(docs, found.collect())
    assert found.where("base_failed and kept").count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = found.where("not base_failed").join(labels, "doc_id")
    good, bad = (judged.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good >= 0.99 and bad <= 0.2


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = line_rules.judge(docs, (line_rules.PRIOR, line_rules.PRIOR_STEP), with_content=True).collect()
    check(docs, found)
    assert {r.content for r in found if not r.n_words} == {""}
    assert line_rules.judge(docs.where("false"), (line_rules.PRIOR, line_rules.PRIOR_STEP)).collect() == []
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert line_rules.learn(docs, nothing)[0] is line_rules.PRIOR


def test_content_lines_are_kept_in_order(spark):
    good = "This is a line of plain text with several words in it."
    bad = "###$$$ BUY!! %%%*** NOW!! |||"
    other = "Another sentence with usual words ends what there is to say."
    text = "\n".join([good, bad, bad + "x", other, bad + "y"])
    row = line_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), (line_rules.PRIOR, line_rules.PRIOR_STEP), with_content=True).first()
    assert row.content == good + "\n" + other


def test_lines_after_the_first_of_long_texts_are_learned(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(line_rules, "fit", lambda features, labels, mask: held.update(labels=labels, mask=mask))
    good = [(i, "\n".join([f"Line {i} {k} is plain text." for k in range(100)] + ["Shared line at the end."])) for i in range(20)]
    bad = [(100 + i, "\n".join([f"Junk {i} {k} ###" for k in range(200)])) for i in range(20)] + [(200, "Shared line at the end.\nBuy ###")]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    line_rules.learn(docs, docs.selectExpr("doc_id", "int(doc_id < 100) as quality"))
    # The shared line is content in the bad text, though it is the last of every good one.
    assert sum(m.sum() == 2 and l[:2].tolist() == [line_rules.CONTENT, line_rules.BOILERPLATE] for l, m in zip(held["labels"], held["mask"], strict=True)) == 1
    starts = [line_rules.window(np.arange(i, i + 200, dtype=np.uint64), 7) for i in range(0, 40_000, 200)]
    assert all(7 <= a < b <= 207 and b - a <= 64 for a, b in starts) and any(b == 207 for _, b in starts) and any(a == 7 for a, _ in starts)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    state, step = rng.normal(size=(17, 2)), rng.normal(size=(2, 2))
    edge = np.array([0, 6, 6, 7, 17])
    labels = line_rules.viterbi(state, step, edge)
    for a, b in itertools.pairwise(edge):
        if a == b:
            continue
        value = lambda y: sum(state[a + i, v] for i, v in enumerate(y)) + sum(step[u, v] for u, v in itertools.pairwise(y))  # noqa: B023, E731
        assert value(labels[a:b]) >= max(map(value, itertools.product((0, 1), repeat=b - a))) - 1e-9


def test_learning_recovers_a_field():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, (200, 12))
    x = np.stack([np.ones_like(y), y + rng.normal(0, 0.3, y.shape)], axis=2).astype(np.float32)
    mask = (np.arange(12) < rng.integers(1, 13, (200, 1))).astype(np.float32)
    theta, step = line_rules.fit(x, y, mask)
    right = [(line_rules.viterbi(x[i][mask[i] > 0] @ theta, step, np.array([0, int(mask[i].sum())])) == y[i][mask[i] > 0]).mean() for i in range(200)]
    assert np.mean(right) > 0.93


def test_contradicting_labels_and_repeated_ids_are_learned_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality").where("quality is not null").dropDuplicates(["doc_id"])
    torn = [r.doc_id for r in labels.orderBy("doc_id").limit(8).collect()]
    without = line_rules.learn(docs, labels.where(~F.col("doc_id").isin(torn)))
    both = labels.unionByName(labels.where(F.col("doc_id").isin(torn)).withColumn("quality", 1 - F.col("quality")))
    nulls = spark.createDataFrame([(None, 0), (None, 1)], labels.schema)
    more = docs.union(docs).union(spark.createDataFrame([(None, "a null id\nof two lines")], docs.schema))
    again = line_rules.learn(more.repartition(5), both.unionByName(nulls).repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(without, again, strict=True))
