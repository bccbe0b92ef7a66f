"""Snapshot, precedence, scope and presence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, sql_lines, sql_trim, table
from plumbline.catalog.derived import DOCS, LINES, doc_lines, docs
from plumbline.catalog.graph import MERGED, merged_history
from plumbline.functions import text as tx
from plumbline.operators import compare
from plumbline.plans.lineage import materialize

MANIFEST = """o AS (SELECT l_suppkey AS k, max(l_partkey) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1),
w AS (SELECT l_suppkey AS k, max(l_partkey) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1)"""


def _years(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_partkey", "l_shipdate")
    cut = F.lit("1997-01-01").cast("timestamp")
    side = lambda cond: li.where(cond).groupBy("k").agg(F.max("l_partkey").alias("v"))
    return side(F.col("l_shipdate") < cut), side(F.col("l_shipdate") >= cut)


@query(
    "manifest_diff",
    f"""WITH {MANIFEST} SELECT coalesce(o.k, w.k) AS k, o.v AS old, w.v AS new, CASE WHEN o.k IS NULL THEN 'Added' WHEN w.k IS NULL THEN 'Removed' ELSE 'Bumped' END AS change
    FROM o FULL JOIN w ON o.k = w.k WHERE o.v IS DISTINCT FROM w.v""",
)
def manifest_diff(spark, d):
    old, new = _years(spark, d)
    return compare.manifest_diff(old, new, ["k"], "v")


@query(
    "outline_diff",
    """WITH o AS (SELECT l_partkey AS k, list_sort(list(DISTINCT l_returnflag)) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), w AS (SELECT l_partkey AS k, list_sort(list(DISTINCT l_returnflag)) AS v FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1)
    SELECT coalesce(o.k, w.k) AS k, CASE WHEN o.k IS NULL THEN 'New' WHEN w.k IS NULL THEN 'Removed' WHEN o.v = w.v THEN 'Unchanged' ELSE 'Changed' END AS change FROM o FULL JOIN w ON o.k = w.k""",
)
def outline_diff(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_linestatus")
    # The flag column has a handful of values, so the sets are bounded.
    side = lambda cond: li.where(cond).groupBy("k").agg(F.collect_set("l_returnflag").alias("v"))
    return compare.outline_diff(side("l_linestatus = 'F'"), side("l_linestatus <> 'F'"), "k", "v")


@query(
    "peer_diff",
    """WITH p AS (SELECT l_partkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), w AS (SELECT l_partkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1),
    x AS (SELECT p_partkey AS k FROM part WHERE p_size < 10)
    SELECT p.k, p.v AS peer, w.v AS new, CASE WHEN w.k IS NULL AND p.k IN (SELECT k FROM x) THEN 'Intentionally-absent' WHEN w.k IS NULL THEN 'Missing' WHEN p.v = w.v THEN 'Mirrored' ELSE 'Diverged' END AS status FROM p LEFT JOIN w ON w.k = p.k""",
)
def peer_diff(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_linestatus", "l_quantity")
    side = lambda cond: li.where(cond).groupBy("k").agg(F.max("l_returnflag").alias("v"))
    exempt = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("k"))
    return compare.peer_diff(side("l_linestatus = 'O'"), side("l_linestatus <> 'O'"), ["k"], "v", exempt)


@query(
    "still_present",
    f"""WITH {DOCS}, {LINES}, e AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN 'gone/' || path ELSE path END AS path,
      CASE WHEN doc_id % 5 = 0 THEN 'changed ' ELSE '' END || {sql_lines('text')}[-1] AS verbatim FROM docs)
    SELECT doc_id AS ev_id, CASE WHEN path IS NOT NULL AND length({sql_trim('verbatim')}) > 0 THEN EXISTS (SELECT 1 FROM lines WHERE lines.path = e.path AND {sql_trim('line')} = {sql_trim('e.verbatim')}) END AS present FROM e""",
)
def still_present(spark, d):
    n = F.col("doc_id")
    t = docs(spark, d)
    last = F.element_at(tx.lines(F.col("text")), -1)
    ev = t.select(
        n.alias("ev_id"),
        F.when(n % 9 == 0, F.lit(None)).when(n % 9 == 1, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"),
        F.concat(F.when(n % 5 == 0, "changed ").otherwise(""), last).alias("verbatim"),
    )
    return compare.still_present(ev, doc_lines(spark, d).select("path", "line"), t.select("path"))


@query(
    "proposals_present",
    f"""WITH {DOCS}, t AS (SELECT DISTINCT 'new/d' || (doc_id * 2) || '.md:7' AS tok, 'd' || (doc_id * 2) || '.md' AS base FROM docs)
    SELECT tok, count(*) AS hits, min(path) AS path FROM t JOIN docs ON regexp_extract(path, '[^/]*$') = base GROUP BY tok""",
)
def proposals_present(spark, d):
    t = docs(spark, d)
    toks = t.select(F.concat(F.lit("new/d"), (F.col("doc_id") * 2).cast("string"), F.lit(".md:7")).alias("tok"))
    return compare.proposals_present(toks, t.select("path"))


ORDERED = {"BUILDING": ["5-LOW", "1-URGENT"], "MACHINERY": ["2-HIGH", "3-MEDIUM", "1-URGENT"]}


@query(
    "precedence",
    """WITH s AS (SELECT c_mktsegment AS subject, o_orderpriority AS source, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    r AS (SELECT *, CASE WHEN subject = 'BUILDING' AND source = '5-LOW' THEN 0 WHEN subject = 'BUILDING' AND source = '1-URGENT' THEN 1 WHEN subject = 'MACHINERY' AND source = '2-HIGH' THEN 0
      WHEN subject = 'MACHINERY' AND source = '3-MEDIUM' THEN 1 WHEN subject = 'MACHINERY' AND source = '1-URGENT' THEN 2 ELSE 1000 END AS rk FROM s)
    SELECT subject, source, n, rk = min(rk) OVER (PARTITION BY subject) AS authoritative FROM r""",
)
def precedence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("source"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("subject"))
    signals = o.join(c, "c_custkey").groupBy("subject", "source").agg(F.count(F.lit(1)).alias("n"))
    return compare.precedence(signals, ORDERED)


@query(
    "ground_truth_fold",
    """WITH r AS (SELECT CASE source WHEN 'src1' THEN 'knip' WHEN 'src2' THEN 'depcruise' WHEN 'src3' THEN 'db' ELSE 'other' END AS tool, CASE lang WHEN 'en' THEN 'exports' WHEN 'fr' THEN 'error' WHEN 'de' THEN 'drift' ELSE 'files' END AS category, doc_id FROM documents)
    SELECT CASE tool WHEN 'knip' THEN 'K-' WHEN 'depcruise' THEN 'DC-' ELSE 'P-' END || doc_id AS id, CASE WHEN tool = 'knip' AND category = 'exports' THEN 'important' WHEN tool = 'knip' THEN 'suggestion' ELSE 'critical' END AS severity
    FROM r WHERE (tool = 'knip' AND category IN ('exports', 'files')) OR (tool = 'depcruise' AND category = 'error') OR (tool = 'db' AND category = 'drift')
    UNION ALL SELECT 'CS-' || s_suppkey, CASE WHEN s_acctbal / 1000 < 7 THEN 'critical' ELSE 'important' END FROM supplier WHERE s_acctbal / 1000 < 9""",
)
def ground_truth_fold(spark, d):
    t = table(spark, d, "documents")
    tool = F.when(F.col("source") == "src1", "knip").when(F.col("source") == "src2", "depcruise").when(F.col("source") == "src3", "db").otherwise("other")
    category = F.when(F.col("lang") == "en", "exports").when(F.col("lang") == "fr", "error").when(F.col("lang") == "de", "drift").otherwise("files")
    rows = t.select(tool.alias("tool"), category.alias("category"), F.col("doc_id").alias("subject"))
    scores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_acctbal") / 1000).alias("score"))
    return compare.ground_truth_fold(rows, scores).select("id", "severity")


SCOPE = "sc AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"


@query("scope_filter", f"WITH {SCOPE} SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT item FROM sc) GROUP BY 1")
def scope_filter(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), "l_returnflag", "l_quantity")
    kept, _ = compare.scope_filter(li, li.where("l_returnflag = 'R' AND l_quantity > 45"))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("scope_dropped", f"WITH {SCOPE} SELECT count(*) AS dropped FROM lineitem WHERE l_partkey NOT IN (SELECT item FROM sc)")
def scope_dropped(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), "l_returnflag", "l_quantity")
    return compare.scope_filter(li, li.where("l_returnflag = 'R' AND l_quantity > 45"))[1]


@query(
    "resolution_check",
    f"""WITH RECURSIVE {MERGED}, ranked AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
    tips AS (SELECT o_custkey, o_orderkey AS tip FROM ranked WHERE r = 3), reached AS (SELECT tip, tip AS node FROM tips UNION SELECT r.tip, m.parent FROM reached r JOIN merged m ON m.child = r.node),
    claims AS (SELECT o_orderkey, tip FROM orders LEFT JOIN tips USING (o_custkey)),
    judged AS (SELECT o_orderkey, CASE WHEN tip IS NULL THEN 'unverified' WHEN (tip, o_orderkey) IN (SELECT tip, node FROM reached) THEN 'resolved' ELSE 'context only' END AS state FROM claims)
    SELECT o_orderkey AS finding, state, CASE WHEN state = 'resolved' THEN 'discuss' ELSE 'important' END AS severity FROM judged""",
)
def resolution_check(spark, d):
    """Every order, claimed as resolved at its customer's third last order."""
    from pyspark.sql import Window

    parents, _ = merged_history(spark, d)
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    tips = o.withColumn("r", F.row_number().over(w)).where("r = 3").select("o_custkey", F.col("o_orderkey").alias("tip"))
    claims = o.join(tips, "o_custkey", "left").select(
        F.col("o_orderkey").alias("finding"), F.col("o_orderkey").alias("commit"), "tip", F.lit("important").alias("severity")
    )
    return compare.resolution_check(materialize(claims, "claims"), parents).select("finding", "state", "severity")


@query(
    "key_coverage",
    """WITH k AS (SELECT p_partkey AS key FROM part WHERE p_size > 3), t AS (SELECT DISTINCT l_returnflag AS tbl FROM lineitem), h AS (SELECT DISTINCT l_partkey AS key, l_returnflag AS tbl FROM lineitem)
    SELECT key, tbl, 'missing' AS problem FROM k, t WHERE (key, tbl) NOT IN (SELECT key, tbl FROM h) UNION ALL SELECT key, tbl, 'orphaned' FROM h WHERE key NOT IN (SELECT key FROM k)""",
)
def key_coverage(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("tbl"), "l_quantity")
    keys = table(spark, d, "part").where("p_size > 3").select(F.col("p_partkey").alias("key"))
    return compare.key_coverage(keys, li.select("tbl"), li)
