from __future__ import annotations

from collections import defaultdict
from functools import cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing
from tests.llm.common import awkward


@cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizer_file():
    encode = packing.encoder()
    for text in ("", "Hello  world\n\n x", "naïve \U0001f600 ‮", "a" * 3000, "<|endoftext|> don't 12,345", "a<|endoftext|>", "<|endoftext|><|endoftext|> <|endoftext", "\x00\x85 "):
        assert [*encode(text).tolist(), 0] == reference(text)


def holds(pieces, texts, window):
    ids = {k: [reference(t) for t in v] for k, v in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        # Every id of every row in one piece.
        assert sum(p.length for p in own) == sum(map(len, ids[k]))
        for doc in ids[k]:
            assert {p.doc_tokens for p in own} == set(map(len, ids[k]))
        if len(ids[k]) == 1:
            own.sort(key=lambda p: p.start)
            assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
            for p in own:
                assert p.ids_crc32 == crc32(np.array(ids[k][0][p.start : p.start + p.length], "<u4").tobytes())
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) <= window
    return len(by_seq) * window - sum(p.length for p in pieces)


def test_awkward_rows(spark):
    docs = awkward(spark)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    holds(packing.pack(docs).collect(), texts, 1024)


@pytest.mark.parametrize("window,most_open,parts", [(64, 2, 1), (128, 4, 7), (1024, 16, 150)])
def test_little_padding(spark, window, most_open, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(parts, "doc_id")
    texts = {r.doc_id: [r.text] for r in docs.collect()}
    pieces = packing.pack(docs, window=window, most_open=most_open).collect()
    padding = holds(pieces, texts, window)
    assert padding < 2 * window * most_open + 0.02 * sum(p.length for p in pieces)


def test_large_ids_beside_null_ids(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 62) + 7, None, -(1 << 61) - 5]
    docs = spark.createDataFrame([(i, f"text number {n} <|endoftext|>") for n, i in enumerate(ids)], "doc_id long, text string")
    found = packing.pack(docs).collect()
    assert sorted((p.doc_id for p in found), key=repr) == sorted(ids, key=repr)
    holds([p for p in found if p.doc_id is not None], {i: [f"text number {n} <|endoftext|>"] for n, i in enumerate(ids) if i is not None}, 1 << 40)


def test_very_long_text(spark):
    text = "Some words of a long text, over and over. " * 50_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert holds(packing.pack(docs).collect(), {1: [text], 2: ["short"]}, 1024) < 1024


def test_empty_table(spark):
    assert packing.pack(awkward(spark).where("false")).collect() == []
