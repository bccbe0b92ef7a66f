from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import mixing
from plumbline.llm.common import load
from tests.llm.common import awkward, tokens
from tests.llm.test_ngram_join import shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DIR = "/root/testdata/sf0.001"


def stages(spark, docs, folder):
    out = [docs]
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / f"{i}{name}")
        f(spark, out[-1], DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_every_stage_takes_effect_and_keeps_the_rest(spark, tmp_path):
    start, known, single, cut, mixed, packed = stages(spark, load(spark, DIR, "documents"), tmp_path)
    for x in (known, single, cut, mixed):
        assert x.columns == COLUMNS
    assert known.count() == start.count()
    # One document of each group: no two left reach the threshold, and each one that went is near one that stayed or went.
    rows = {r.doc_id: shingle_set(r.text) for r in known.collect()}
    left = [r.doc_id for r in single.collect()]
    near = lambda a, b: bool(rows[a]) and 100 * len(rows[a] & rows[b]) >= 75 * len(rows[a] | rows[b])
    assert len(set(left)) == len(left) and not any(near(a, b) for i, a in enumerate(left) for b in left[:i])
    for gone in set(rows) - set(left):
        assert any(near(gone, b) for b in rows if b != gone)
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        assert r.n_chars == len(r.text) and set(tokens(r.text)) <= set(tokens(texts[r.doc_id]))
    words = {r.doc_id: len(tokens(r.text)) for r in cut.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(words)
    total = sum(len(tokens(r.text)) for r in mixed.collect())
    assert abs(total - 1.5 * sum(words.values())) <= 20
    assert sum(r.length for r in packed.collect()) > total


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    out = stages(spark, docs, tmp_path)
    assert [set(x.columns) for x in out[:-1]] == [set(docs.columns)] * 5
    assert sorted({repr(r.doc_id) for r in out[1].collect()}) == ["1", "5", "6", "8", "None"]
    assert sorted(repr(r.doc_id) for r in out[2].collect()) == ["1", "5", "8"]


def test_stages_on_no_rows(spark, tmp_path):
    out = stages(spark, awkward(spark).where("false"), tmp_path)
    assert [x.count() for x in out] == [0] * 6


def test_the_mix_has_each_text_as_often_as_it_is_taken(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "COPIES", 3)
    rows = [(1, "one two three", "en", "a", 13), (2, "four", "en", "b", 4), (None, "five six", None, None, 8), (3, None, "en", "a", None), (4, "  ", "en", "a", 2)]
    docs = spark.createDataFrame(rows + [(9, "same old words", "en", "a", 14)] * 20, "doc_id long, text string, lang string, source string, n_chars long")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(*docs.columns).cast("string"))
    want, names = Counter(), {repr(r.doc_id): r.text for r in docs.collect()}
    for r in mixing.mix(docs.withColumn("name", F.col("doc_id")), key).collect():
        text = names[r.doc_key.split(":")[0] if r.doc_key.count(":") else "None"]
        if r.taken:
            want[text] += r.taken // r.size
            want[" ".join(tokens(text)[: r.taken % r.size])] += 1
    found = Counter(r.text for r in corpus_pipeline.mixed(spark, docs, DIR).collect())
    want.pop("", None)
    assert found == +want and sum(len(tokens(t)) * n for t, n in found.items()) > 60


def test_intermediate_tables_go_when_the_next_stage_begins(spark, tmp_path):
    docs = load(spark, DIR, "documents").limit(50)
    stored = corpus_pipeline._left.__dict__.setdefault("stored", [])
    corpus_pipeline.mixed(spark, docs, DIR).write.parquet(str(tmp_path / "mixed"))
    held = list(stored)
    assert held and all(Path(p.removeprefix("file:")).exists() for p in held)
    corpus_pipeline.known_language(spark, docs, DIR).write.parquet(str(tmp_path / "known"))
    assert not any(Path(p.removeprefix("file:")).exists() for p in held)
