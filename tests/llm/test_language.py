from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, queries
from plumbline.llm.arrays import chunks
from tests.llm.common import awkward


def plain_bits(train: list[str], text: str, order: int) -> float:
    """Code length by the definition, one byte and one context at a time."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    counts: dict[bytes, dict[int, int]] = {}
    for t in train:
        raw = b" " * order + t.encode().translate(low)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                own = counts.setdefault(raw[i - k : i], {}) if k else counts.setdefault(b"", {})
                own[raw[i]] = own.get(raw[i], 0) + 1
    raw, bits = b" " * order + text.encode().translate(low), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            own = counts.get(raw[i - k : i] if k else b"")
            if own is None:
                continue
            total = sum(own.values()) + len(own)
            if raw[i] in own:
                bits -= math.log2(own[raw[i]] / total)
                break
            bits -= math.log2(len(own) / total)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_by_definition(spark, order):
    texts = {"a": ["abra Cadabra", "abc é"], "b": ["xyz zyx", "", "abracadabra!"]}
    rows = [(k, t) for k, v in texts.items() for t in v]
    model = language.Model(language.train(spark.createDataFrame(rows, "lang string, text string"), order), order)
    for text in ("abra", "zyx abc", "\x00\x01", "ééé", "A"):
        ((_, _, data, offsets),) = chunks(pa.array([text]))
        found = model.lengths(language.grams(data, offsets, order)[0], order).sum(axis=0)
        assert np.allclose(found, [plain_bits(texts[k], text, order) for k in "ab"], atol=1e-3)


def test_the_sample_of_rows_without_ids_is_bounded(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n // 6))
    rows = [(None, text(600), "a") for _ in range(600)] + [(i, text(300_000), "b") for i in range(2)] + [(9, "few words", "c")]
    seen = {}
    monkeypatch.setattr(language, "Model", lambda trained, order: seen.update({lang: int(levels[0][1].sum()) for lang, levels in trained}))
    for first in range(3):
        docs = spark.createDataFrame([(i if i is None else i + 10 * first, t, k) for i, t, k in rows], "doc_id long, text string, lang string")
        language.learn(docs, F.lit(True), F.col("doc_id"), 1, 100_000)
        assert 50_000 < seen["a"] < 200_000 and 30_000 < seen["b"] < 200_000 and seen["c"] == 9
        seen.clear()


def test_pieces_of_a_long_text_count_like_the_whole(spark, monkeypatch):
    monkeypatch.setattr(language, "PART", 1000)
    text = "".join(chr(97 + i * i % 23) for i in range(5003))
    ((_, levels),) = language.train(spark.createDataFrame([("a", text)], "lang string, text string"), 2)
    whole = language.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 2)[0]
    code, n = np.unique(whole, return_counts=True)
    assert levels[2][0].tolist() == code.tolist() and levels[2][1].tolist() == n.tolist()


def test_held_out_accuracy_without_peeking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = queries.QUERIES["op3_identify_language"](spark, "/root/testdata/sf0.001")
    right = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = language.learn(docs, F.lit(True), F.coalesce("doc_id", F.lit(0)))
    found = language.identify(docs, model, docs.columns).collect()
    assert len(found) == 11
    for r in found:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letter and 0 <= r.score <= 1 and (r.bits_per_byte is not None) == letter
    assert language.identify(docs.where("false"), model, ["doc_id"]).collect() == []
    none = language.learn(docs.where("false"), F.lit(True), F.lit(0))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none, ["doc_id"]).collect()} == {("und", 0.0)}


def test_a_long_text_in_parts_costs_the_same(spark):
    rows = [("a", "the cat sat on the mat " * 50), ("b", "der hund und die katze " * 50)]
    model = language.Model(language.train(spark.createDataFrame(rows, "lang string, text string"), 4), 4)
    text = ("the hund and die cat " * 130_000)[: (1 << 21) + 7]
    found = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    ((_, _, data, offsets),) = chunks(pa.array([text]))
    whole = model.lengths(language.grams(data, offsets, 4)[0], 4).sum(axis=0, dtype=np.float64)
    assert found.bits_per_byte == pytest.approx(whole.min() / len(data), rel=1e-6)


def test_every_label_is_learned_within_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [["".join(rng.choice(list("abcdefghijklmnop"), 4)) for _ in range(40)] for _ in range(60)]
    rows = [(f"l{j}", " ".join(rng.choice(words[j], 30))) for j in range(60) for _ in range(40)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    model = language.learn(docs, F.lit(True), F.col("doc_id"), all_bytes=60_000)
    assert len(model.langs) == 60 and model.cost[0].cost.size < 60 * 20
    found = language.identify(docs, model, ["doc_id", "lang"])
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    monkeypatch.setattr(language, "COSTS", 1000)
    ((_, _, data, offsets),) = chunks(pa.array([r[1] for r in rows[:50]]))
    code, row = language.grams(data, offsets, 4)
    want = np.array([model.lengths(code[row == r], 4).sum(axis=0) for r in range(50)])
    assert np.allclose(model.totals(code, row, 50), want, rtol=1e-5)


def test_held_out_and_null_labels_are_never_learned(spark):
    docs = spark.createDataFrame([(1, "x", "aaa aaa"), (2, None, "bbb bbb"), (3, "z", "ccc ccc")], "doc_id long, lang string, text string")
    assert language.learn(docs, F.col("doc_id") != 3, F.col("doc_id")).langs == ["x"]
