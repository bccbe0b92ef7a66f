"""Plain-Python counterparts and awkward inputs for the tests of this folder."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, _key int"


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "Alpha beta\tgamma", "en", "b", 16, 0.5, "x", 1), (1, "Alpha beta\tgamma", "en", "b", 16, 0.5, "x", 1),
        (2, None, "en", "a", None, None, None, None), (3, "", None, None, 0, 1.0, "y", 2), (4, " \n\t ", "de", "a", 4, 1.0, "y", 2),
        (None, "Alpha beta gamma", "de", "b", 16, 0.5, "x", 1), (None, None, None, None, None, None, None, None),
        (5, long, "en", "a", len(long), 0.1, "z", 3), (6, long, "en", "a", len(long), 0.1, "z", 3),
        (7, "123 456 ### 789", None, "c", 15, 0.1, "z", 3), (8, "é\u00a0ü \U0001f600 x", "fr", "b", 7, 0.1, "z", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
