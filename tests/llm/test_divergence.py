from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import divergence, queries
from tests.llm.common import DOCS, LOWER, awkward
from tests.oracle import compare, connect

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, documents=30, ranks=50):
    docs = [(r.text or "", r.lang or "", r.source or "") for r in docs]
    held, found = defaultdict(set), defaultdict(Counter)
    for r, (text, lang, source) in enumerate(docs):
        found[lang, source]
        for term in TERM.findall(text.translate(LOWER)):
            held[lang, term].add(r)
            found[lang, source][term] += 1
    out = []
    for lang in {x for x, _ in found}:
        kept = [t for (x, t), rows in held.items() if x == lang and len(rows) >= documents]
        sources = {s: c for (x, s), c in found.items() if x == lang}
        total = {t: sum(c[t] for c in sources.values()) for t in kept}

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in sources.items()}, shares(total)
        for s in sources:
            near = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -f, i) for i, (f, _, o) in enumerate(near, 1)]
            own = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if sources[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -f, i) for i, (f, _, t) in enumerate(own[:ranks], 1)]
    return sorted(out)


def run(docs, **conf):
    return sorted(tuple(r) for r in divergence.audit(docs, **conf).collect())


@pytest.mark.parametrize("first", [1, 4, 64])
def test_against_brute_force(spark, first):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = run(docs, documents=5, first=first)
    assert found == brute(docs.collect(), 5)
    assert {r[2] for r in found} == {"pair", "term"}


def test_like_sql(spark):
    at = "/root/testdata/sf0.01"
    assert compare(queries.op13(spark, at), connect(at), queries.DIVERGENCE_SQL) == []


def test_blocks_chunks_and_slices(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = run(docs, documents=4)
    for name, value in {"CHUNK": 7, "BLOCK": 3, "MOST": 500, "PART": 300}.items():
        monkeypatch.setattr(divergence, name, value)
        assert run(docs, documents=4) == want, name


def test_awkward_rows(spark):
    docs = awkward(spark)
    for documents in (1, 2, 30):
        assert run(docs, documents=documents) == brute(docs.collect(), documents)
    assert run(docs.where("false")) == []
    rows = [(i, "Ünder é x a-b_c\x00d " + "long" * 40, None if i % 2 else "de", f"s{i % 3}", 1, 1.0, "h", 1) for i in range(12)]
    rows += [(20, None, "de", "s9", 1, 1.0, "h", 1), (21, "alone", "fr", None, 1, 1.0, "h", 1)]
    more = spark.createDataFrame(rows, DOCS)
    for documents in (1, 6, 7):
        assert run(more, documents=documents) == brute(more.collect(), documents)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 64)
    text = "word " * 200 + "x" * 500 + " end"
    column = pa.array(["a b", text, None, "c"], pa.string())
    out = []
    for lo, data, offsets in divergence.parts(column):
        for r in range(len(offsets) - 1):
            out += [(lo + r, t) for t in TERM.findall(bytes(data[offsets[r] : offsets[r + 1]]).decode())]
    assert out == [(r, t) for r, x in enumerate(column.to_pylist()) for t in TERM.findall(x or "")]


def test_levels_drop_rare_prefixes(spark):
    # Of "tablet" and "tableau" four documents each hold one: the prefix of four stays, the terms go.
    rows = [(i, "tablet" if i % 2 else "tableau") for i in range(4)]
    texts = spark.createDataFrame([(t, "en") for _, t in rows], "text string, lang string")
    first = divergence.level(texts, 4, 0, 4, None)
    whole, kept, longer = divergence.bitmaps(first)
    assert first.count() == 1 and longer and not whole.any() and np.unpackbits(kept).sum() == 1
    assert divergence.level(texts, 4, 4, 8, kept).count() == 0
    assert divergence.level(texts, 2, 4, 8, kept).count() == 2
    assert divergence.level(texts, 1, 4, 8, np.zeros_like(kept)).count() == 0


def test_rows_that_hold_a_hash(monkeypatch):
    row = np.array([3, 3, 3, 5, 5, 9, 9, 12, 40, 41])
    h = np.array([7, 7, 8, 7, 9, 7, 8, 8, 7, 7], np.uint64) | np.uint64(1 << 60)
    for bits in (22, 2, 1):
        monkeypatch.setattr(divergence, "ROW_BITS", bits)
        found = Counter()
        for x, n in zip(*divergence.holders(row, h), strict=True):
            found[int(x) & 15] += int(n)
        assert found == {7: 5, 8: 3, 9: 1}
    assert [len(x) for x in divergence.holders(row[:0], h[:0])] == [0, 0]


def test_short_and_long_spans_have_one_hash():
    data = np.frombuffer(b"Abc abc abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQ", np.uint8)
    _, begin, end = divergence.places(data, np.array([0, len(data)]))
    alone = [int(divergence.spans(data, begin[i : i + 1], end[i : i + 1])[0]) for i in range(len(begin))]
    assert divergence.spans(data, begin, end).tolist() == alone == divergence.words(data, np.array([0, len(data)]))[0].tolist()
    cut = np.minimum(end, begin + 3)
    assert len(set(divergence.spans(data, begin, cut).tolist())) == 1
