from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import arrays
from tests.llm.common import tokens

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbB é\U0001f600\n\t\x1c\x85 "), max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 60))
def test_words_and_shingles_equal_plain_python(column, most):
    seen: dict[int, str] = {}
    runs: dict[int, tuple] = {}
    rows = 0
    for lo, hi, data, offsets in arrays.chunks(pa.array(column, pa.string()), most):
        assert lo == rows
        rows = hi
        h, row, begin, end = arrays.words(data, offsets)
        raw = data.tobytes()
        expected = [(r, w) for r in range(hi - lo) for w in tokens(column[lo + r])]
        assert list(zip(row.tolist(), [raw[b:e].decode().translate({i: i + 32 for i in range(65, 91)}) for b, e in zip(begin, end, strict=True)], strict=True)) == expected
        for x, (_, w) in zip(h.tolist(), expected, strict=True):
            assert seen.setdefault(x, w) == w
        sh, of = arrays.shingles(h, row, hi - lo)
        want = []
        for r in range(hi - lo):
            w = tokens(column[lo + r])
            want += [(r, tuple(w[i : i + 5])) for i in range(len(w) - 4)] if len(w) >= 5 else [(r, tuple(w))] if w else []
        assert of.tolist() == [r for r, _ in want]
        for x, (_, w) in zip(sh.tolist(), want, strict=True):
            assert runs.setdefault(x, w) == w
    assert rows == len(column)
    assert len(set(seen.values())) == len(seen) and len(set(runs.values())) == len(runs)


def test_a_word_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(arrays, "SEGMENT", 8)
    column = pa.array(["x" * 50 + " ab " + "y" * 9 + " ab", "ab " * 30])
    ((_, _, data, offsets),) = arrays.chunks(column)
    h, row, begin, _ = arrays.words(data, offsets)
    assert len(h) == 34 and len(set(h.tolist())) == 3
    assert h[1] == h[3] == h[10] and np.all(np.diff(begin) > 0) and row[4] == 1
