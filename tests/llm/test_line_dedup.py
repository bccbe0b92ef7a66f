from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, queries
from tests.llm.common import DOCS, LOWER, awkward
from tests.oracle import compare, connect


def brute(rows, documents=3, chars=20):
    """Kept texts by the rule, for rows of ``id, text``; every row is a document."""
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)
    held = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held[key(line)].add(r)
    least = float("-inf")
    number = lambda i: least if i is None else i
    keeper = {k: max(number(rows[r][0]) for r in found) for k, found in held.items() if len(k) >= chars and len(found) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), least) in (least, number(i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def run(df, **conf):
    return sorted((tuple(r) for r in line_dedup.dedup(df, **conf).collect()), key=repr)


LINE = "A line that many pages hold"


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = run(docs)
    assert found == brute(pairs(docs))
    assert sum(r[3] for r in found) > 100


def test_lines_stay_in_the_largest_id(spark):
    rows = [(i, f"own line of {i}, all of it\n{LINE if i % 2 else ' ' + LINE.upper() + chr(13)}\n\n{LINE}") for i in range(1, 6)]
    rows += [(9, "Short line\nunder two docs, this line"), (10, "Short line\nunder two docs, this line"), (11, "Short line")]
    found = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute(rows)
    kept = {r[0]: r for r in found}
    assert kept[5][1] == rows[4][1] and kept[1][1:] == ("own line of 1, all of it\n", 4, 2)
    assert kept[9][1] == rows[5][1] and kept[11][1] == "Short line"


def test_counting_documents_not_lines(spark):
    rows = [(1, "\n".join([LINE] * 50)), (2, LINE)]
    assert [r[3] for r in run(spark.createDataFrame(rows, "doc_id long, text string"))] == [0, 0]


def test_code_points_and_white_space(spark):
    nineteen, twenty = "é" * 19, "é" * 20
    blank = " " + "x" * 19  # a no-break space is no white space here
    rows = [(i, f"{nineteen}\n\x0b {twenty}\t\r\n{blank}\nÄÖÜ and enough of letters\näöü and enough of letters") for i in range(4)]
    found = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute(rows) and {r[3] for r in found} == {0, 4}


def test_awkward_rows(spark):
    docs = awkward(spark)
    for line in ("", LINE):
        more = docs.union(spark.createDataFrame([(i, line + "\nx", None, "a", 1, 1.0, line, 1) for i in (None, None, None, 7, 7, 7, 8)], DOCS))
        assert run(more) == brute(pairs(more))
    nulls = spark.createDataFrame([(None, LINE)] * 4, "doc_id long, text string")
    assert run(nulls) == [(None, LINE, 1, 0)] * 4
    assert run(docs.where("false")) == []


def test_a_line_in_a_third_of_all_rows_and_a_long_text(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("number "), F.col("id"), F.lit(" has this line\n"), F.when(F.col("id") % 3 == 0, F.lit(LINE)).otherwise(F.lit("-"))).alias("text")
    )
    long = "\n".join(f"{LINE} {i % 5000}" for i in range(40_000))
    docs = docs.union(spark.createDataFrame([(i, long) for i in (-1, -2, 5000)], "doc_id long, text string"))
    assert run(docs) == brute(pairs(docs))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_like_sql(spark, folder):
    at = f"/root/testdata/{folder}"
    assert compare(queries.op12(spark, at), connect(at), queries.LINE_SQL) == []
