"""Ranking, carry-forward and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.catalog.derived import DOCS, FINDINGS, LINES, doc_lines, findings
from plumbline.functions.records import layer_key
from plumbline.operators import windows


@query(
    "top_per_group",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 12""",
)
def top_per_group(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return windows.top_per_group(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 12)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
def top_k(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return windows.top_k(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 60)


@query("recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent(spark, d):
    return windows.recent(table(spark, d, "events").select("event_id", "event_type", "ts"), "ts", "event_id").select("event_id", "event_type")


@query(
    "latest_wins",
    """SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, CAST(length(arg_max(text, turn)) AS INTEGER) AS chars FROM conversations GROUP BY conv_id""",
)
def latest_wins(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    return windows.latest_wins(c, ["conv_id"], ["turn", "chars"])


@query(
    "first_seen",
    f"""WITH {FINDINGS}, k AS (SELECT DISTINCT tag, CAST(string_split(layer, '.')[1] AS INTEGER) AS major,
      coalesce(CAST(string_split(layer, '.')[2] AS INTEGER), -1) AS minor FROM findings WHERE tag IS NOT NULL)
    SELECT tag, major, minor, CASE WHEN row_number() OVER (PARTITION BY tag ORDER BY major, minor) = 1 THEN 'introduced' ELSE 'reused' END AS state FROM k""",
)
def first_seen(spark, d):
    k = layer_key(F.col("layer"))
    f = findings(spark, d).select(F.col("crossCutTag").alias("tag"), k["major"].alias("major"), k["minor"].alias("minor"))
    return windows.first_seen(f, "tag", "major", "minor")


@query(
    "running_section",
    f"""WITH {DOCS}, {LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN line_no END AS heading FROM lines)
    SELECT doc_id, line_no, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h""",
)
def running_section(spark, d):
    lines = doc_lines(spark, d).select(
        "doc_id", "line_no", F.when(F.col("line").rlike("^[A-Z][a-z]+ "), F.col("line_no")).alias("heading")
    )
    return windows.carry_forward(lines, ["doc_id"], "line_no", "heading", "section", block=16).select("doc_id", "line_no", "section")


BUDGET = """b AS (SELECT source, doc_id, lang || ' ' || doc_id AS row_text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
u AS (SELECT *, sum(length(row_text) + 1) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM b)"""


@query(
    "byte_budget",
    f"""WITH {BUDGET}, k AS (SELECT source, count(*) AS kept FROM u WHERE rank <= 40 AND used <= 200 GROUP BY source), t AS (SELECT source, count(*) AS total FROM u GROUP BY source)
    SELECT source, total, coalesce(kept, 0) AS kept, total - coalesce(kept, 0) AS dropped FROM t LEFT JOIN k USING (source)""",
)
def byte_budget(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("row_text"))
    kept = windows.byte_budget(t, ["source"], [F.col("doc_id").asc()], "row_text", rows=40, size=200)
    return windows.budget_report(t, ["source"], kept)


@query(
    "report_blocks",
    """WITH e AS (SELECT 'en' AS label UNION ALL SELECT 'fr' UNION ALL SELECT 'de' UNION ALL SELECT 'xx'),
    r AS (SELECT lang AS label, doc_id, source || chr(9) || doc_id || chr(10) AS line, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS total FROM documents),
    t AS (SELECT label, string_agg(line, '' ORDER BY rank) AS body, max(total) - count(*) AS left_out FROM r WHERE rank <= 20 GROUP BY label)
    SELECT e.label, '---' || e.label || '---' || chr(10) || coalesce(body, '') || CASE WHEN left_out > 0 THEN '(... ' || left_out || ' more truncated ...)' || chr(10) ELSE '' END AS block
    FROM e LEFT JOIN t USING (label)""",
)
def report_blocks(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("lang").alias("label"), F.col("doc_id").alias("pos"), F.concat_ws("\t", "source", F.col("doc_id").cast("string")).alias("line")
    )
    out = windows.shared_budget(rows, ["en", "fr", "de", "xx"], max_rows=20)
    return out.select(F.explode("texts").alias("block")).select(F.regexp_extract("block", "^---(..)---", 1).alias("label"), "block")


@query(
    "distinct_union",
    f"""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49)
    SELECT k, CASE WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) THEN 'both' WHEN k IN (SELECT k FROM a) THEN 'first' ELSE 'second' END AS found
    FROM (SELECT k FROM a UNION SELECT k FROM b)""",
)
def distinct_union(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_returnflag", "l_quantity")
    a, b = li.where("l_returnflag = 'R'").select("k").distinct(), li.where("l_quantity > 49").select("k").distinct()
    both = a.intersect(b).select("k", F.lit("both").alias("found"))
    return both.unionByName(a.exceptAll(b).select("k", F.lit("first").alias("found"))).unionByName(
        b.exceptAll(a).select("k", F.lit("second").alias("found"))
    )
