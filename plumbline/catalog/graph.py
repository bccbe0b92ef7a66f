"""Graph queries: parts as modules, brands as folders, consecutive order lines as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.catalog.changelog import CAP, PAIRS
from plumbline.catalog.derived import (
    DOCS,
    MODULES,
    PART_EDGES,
    PART_STEPS,
    SUCCESSOR,
    main_successor,
    modules,
    part_edges,
    part_steps,
    sized_docs,
    supply_changes,
)
from plumbline.catalog.profile import PROFILE
from plumbline.operators import changelog, dag, graph, profile
from plumbline.plans.lineage import materialize

COMPONENTS = """reach AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e UNION SELECT r.x, CASE WHEN e.a = r.y THEN e.b ELSE e.a END FROM reach r JOIN e ON r.y IN (e.a, e.b)),
comp AS (SELECT x AS node, least(x, min(y)) AS component FROM reach GROUP BY x)"""


@query(
    "ripple_groups",
    f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE support >= 4), {COMPONENTS}
    SELECT component AS group_id, node, count(*) OVER (PARTITION BY component) AS size FROM comp""",
)
def ripple_groups(spark, d):
    pairs = changelog.co_change(supply_changes(spark, d), min_conf=0.04, **CAP)
    return graph.ripple_groups(materialize(pairs, "pairs")).select("group_id", "node", "size")


@query(
    "ripple_modules",
    f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE support >= 4), {COMPONENTS}
    SELECT component AS group_id, count(DISTINCT node) AS size, count(DISTINCT s_nationkey) AS modules FROM comp JOIN supplier ON s_suppkey = node GROUP BY component""",
)
def ripple_modules(spark, d):
    pairs = changelog.co_change(supply_changes(spark, d), min_conf=0.04, **CAP)
    groups = graph.ripple_groups(materialize(pairs, "pairs")).drop("module")
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("module"))
    return graph.ripple_modules(groups.join(nations, "node"))


CORE = "inst AS (SELECT s.folder, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, s.modules, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0.0 END AS instability FROM sizes s LEFT JOIN ca USING (folder) LEFT JOIN ce USING (folder))"
FOLDERS = f"""{PART_EDGES}, x AS (SELECT DISTINCT src, dst, string_split(src, '/')[1] AS sf, string_split(dst, '/')[1] AS df FROM edges),
ca AS (SELECT df AS folder, count(DISTINCT src) AS ca FROM x WHERE sf <> df GROUP BY df),
ce AS (SELECT sf AS folder, count(DISTINCT dst) AS ce FROM x WHERE sf <> df GROUP BY sf),
sizes AS (SELECT string_split(path, '/')[1] AS folder, count(*) AS modules FROM modules GROUP BY 1),
{CORE}"""


@query("instability", f"WITH {FOLDERS} SELECT folder, ca, ce, modules, round(instability, 6) AS instability FROM inst")
def instability(spark, d):
    out = graph.instability(part_edges(spark, d), modules(spark, d))
    return out.withColumn("instability", F.round("instability", 6))


@query(
    "sdp_violations",
    f"""WITH {FOLDERS}, fe AS (SELECT sf, df, count(*) AS edges, min(src || ' -> ' || dst) AS sample FROM x WHERE sf <> df GROUP BY ALL)
    SELECT sf AS src_folder, df AS dst_folder, edges, round(b.instability - a.instability, 6) AS delta FROM fe JOIN inst a ON a.folder = sf JOIN inst b ON b.folder = df WHERE b.instability - a.instability >= 0.01""",
)
def sdp_violations(spark, d):
    return graph.sdp_violations(materialize(part_edges(spark, d), "edges"), 0.01).select(
        "src_folder", "dst_folder", "edges", F.round("delta", 6).alias("delta")
    )


@query(
    "volatile_hubs",
    f"""WITH {MODULES}, s AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey),
    i AS (SELECT b AS partkey, count(*) AS inbound FROM s GROUP BY b), c AS (SELECT l_partkey AS partkey, count(*) AS commits FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 180 DAY GROUP BY 1)
    SELECT path AS item, commits, inbound, commits * inbound AS score FROM c JOIN i USING (partkey) JOIN modules USING (partkey) WHERE commits >= 2 AND inbound >= 2""",
)
def volatile_hubs(spark, d):
    m = modules(spark, d).select(F.col("partkey").alias("l_partkey"), F.col("path").alias("item"))
    ships = changelog.in_window(table(spark, d, "lineitem").select("l_partkey", "l_shipdate"), "l_shipdate")
    churn = ships.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("commits")).join(m, "l_partkey").select("item", "commits")
    return graph.volatile_hubs(churn, part_edges(spark, d))


WALK = "walk AS (SELECT src AS origin, dst AS node FROM succ WHERE src <> dst UNION SELECT w.origin, s.dst FROM walk w JOIN succ s ON s.src = w.node), cyc AS (SELECT origin AS node FROM walk WHERE origin = node)"


@query(
    "strongly_connected",
    f"""WITH RECURSIVE {SUCCESSOR}, {WALK} SELECT c.node, max(w.node) AS scc FROM cyc c JOIN walk w ON w.origin = c.node GROUP BY c.node""",
)
def strongly_connected(spark, d):
    return graph.strongly_connected(materialize(main_successor(spark, d), "succ"))


@query(
    "cycles",
    f"""WITH RECURSIVE {SUCCESSOR}, {WALK}, m AS (SELECT c.node, min(w.node) AS start, count(*) AS size FROM cyc c JOIN walk w ON w.origin = c.node GROUP BY c.node),
    p AS (SELECT start, start AS node, size, CAST(start AS VARCHAR) AS path, 0 AS length FROM m WHERE node = start
      UNION ALL SELECT p.start, s.dst, p.size, p.path || ' -> ' || s.dst, p.length + 1 FROM p JOIN succ s ON s.src = p.node WHERE p.length < p.size)
    SELECT size, CAST(length AS INTEGER) AS length, path FROM p WHERE length = size""",
)
def cycles(spark, d):
    return graph.cycles(materialize(main_successor(spark, d), "succ")).select("size", "length", "path")


@query(
    "cycle_steps",
    f"""WITH RECURSIVE {SUCCESSOR}, {WALK}, m AS (SELECT c.node, min(w.node) AS start, count(*) AS size FROM cyc c JOIN walk w ON w.origin = c.node GROUP BY c.node),
    p AS (SELECT start, start AS node, size, 0 AS pos FROM m WHERE node = start UNION ALL SELECT p.start, s.dst, p.size, p.pos + 1 FROM p JOIN succ s ON s.src = p.node WHERE p.pos + 1 < p.size)
    SELECT size, CAST(pos AS BIGINT) AS pos, node FROM p""",
)
def cycle_steps(spark, d):
    return graph.cycle_steps(materialize(main_successor(spark, d), "succ")).select("size", "pos", "node")


@query(
    "ancestors",
    f"""WITH RECURSIVE {SUCCESSOR}, t AS (SELECT p_partkey AS tip FROM part WHERE p_size = 1), r AS (SELECT tip, tip AS node FROM t UNION SELECT r.tip, s.dst FROM r JOIN succ s ON s.src = r.node)
    SELECT tip, node FROM r""",
)
def ancestors(spark, d):
    tips = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("tip"))
    parents = materialize(main_successor(spark, d), "succ").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return dag.ancestors(parents, tips).select("tip", "node")


# History of a customer's orders: each order follows the customer's previous one.
HISTORY = """seq AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_custkey FROM orders),
ends AS (SELECT o_custkey, max(CASE WHEN k = 2 THEN child END) AS a, max(CASE WHEN k = 5 THEN child END) AS b FROM seq GROUP BY o_custkey HAVING count(*) >= 5)"""


def order_history(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    seq = o.select("o_custkey", F.col("o_orderkey").alias("child"), F.lag("o_orderkey").over(w).alias("parent"), F.row_number().over(w).alias("k"))
    seq = materialize(seq, "history")
    ends = seq.groupBy("o_custkey").agg(
        F.max(F.when(F.col("k") == 2, F.col("child"))).alias("a"),
        F.max(F.when(F.col("k") == 5, F.col("child"))).alias("b"),
    )
    return seq.where("parent IS NOT NULL").select("child", "parent"), ends.where("b IS NOT NULL").select("o_custkey", "a", "b")


@query(
    "commit_range",
    f"""WITH {HISTORY} SELECT least(a, b) AS x, greatest(a, b) AS y, seq.child AS node FROM ends JOIN seq ON seq.o_custkey = ends.o_custkey WHERE k BETWEEN 3 AND 5""",
)
def commit_range(spark, d):
    parents, ends = order_history(spark, d)
    # Half of the ranges are given the wrong way round and must be swapped.
    pairs = ends.select(
        F.when(F.col("o_custkey") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("b"),
    )
    return dag.commit_range(parents, pairs).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "node")


@query("merge_base", f"WITH {HISTORY} SELECT a, b, a AS base FROM ends")
def merge_base(spark, d):
    parents, ends = order_history(spark, d)
    return dag.merge_base(parents, ends.select("a", "b"))


# The same with merges: every fifth order also follows the order before it on its day, mostly another customer's.
MERGED = f"""{HISTORY}, days AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS parent FROM orders),
merged AS (SELECT child, parent FROM seq WHERE parent IS NOT NULL UNION SELECT child, parent FROM days WHERE parent IS NOT NULL AND child % 5 = 0)"""
# Whatever is reached from the orders of `tips`.
REACHED = "reached AS (SELECT tip, tip AS node FROM tips UNION SELECT r.tip, m.parent FROM reached r JOIN merged m ON m.child = r.node)"


def merged_history(spark, d):
    """``child, parent`` with merges, and each customer's second and fifth order ``o_custkey, a, b``."""
    from pyspark.sql import Window

    parents, ends = order_history(spark, d)
    w = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    days = table(spark, d, "orders").select(F.col("o_orderkey").alias("child"), F.lag("o_orderkey").over(w).alias("parent"))
    days = days.where("parent IS NOT NULL AND child % 5 = 0")
    return materialize(parents.unionByName(days).distinct(), "merged"), ends


@query(
    "is_ancestor",
    f"""WITH RECURSIVE {MERGED}, tips AS (SELECT o_orderkey AS tip FROM orders), {REACHED},
    pairs AS (SELECT lag(o_orderkey, 3) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS a, o_orderkey AS b FROM orders)
    SELECT a, b, (b, a) IN (SELECT tip, node FROM reached) AS is_ancestor FROM pairs WHERE a IS NOT NULL
    UNION ALL SELECT a, b, true FROM ends WHERE b IS NOT NULL UNION ALL SELECT b, a, false FROM ends WHERE b IS NOT NULL""",
)
def is_ancestor(spark, d):
    from pyspark.sql import Window

    parents, ends = merged_history(spark, d)
    w = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    near = table(spark, d, "orders").select(F.lag("o_orderkey", 3).over(w).alias("a"), F.col("o_orderkey").alias("b")).where("a IS NOT NULL")
    pairs = near.unionByName(ends.select("a", "b")).unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return dag.is_ancestor(parents, materialize(pairs, "pairs"))


@query(
    "ancestors_merged",
    f"""WITH RECURSIVE {MERGED}, tips AS (SELECT b AS tip FROM ends WHERE b IS NOT NULL),
    r AS (SELECT tip, tip AS node, 0 AS depth FROM tips UNION SELECT r.tip, m.parent, r.depth + 1 FROM r JOIN merged m ON m.child = r.node)
    SELECT tip, node, min(depth) AS depth FROM r GROUP BY tip, node""",
)
def ancestors_merged(spark, d):
    parents, ends = merged_history(spark, d)
    return dag.ancestors(parents, ends.select(F.col("b").alias("tip")))


@query(
    "commit_range_merged",
    f"""WITH RECURSIVE {MERGED}, tips AS (SELECT a AS tip FROM ends WHERE b IS NOT NULL UNION SELECT b FROM ends WHERE b IS NOT NULL), {REACHED}
    SELECT a, b, node FROM ends JOIN reached ON tip = b WHERE (a, node) NOT IN (SELECT tip, node FROM reached)""",
)
def commit_range_merged(spark, d):
    parents, ends = merged_history(spark, d)
    return dag.commit_range(parents, ends.select("a", "b"))


@query(
    "merge_base_merged",
    f"""WITH RECURSIVE {MERGED}, pairs AS (SELECT b AS a, lead(b) OVER (ORDER BY o_custkey) AS b FROM ends WHERE b IS NOT NULL),
    tips AS (SELECT a AS tip FROM pairs WHERE b IS NOT NULL UNION SELECT b FROM pairs WHERE b IS NOT NULL),
    r AS (SELECT tip, tip AS node, 0 AS depth FROM tips UNION SELECT r.tip, m.parent, r.depth + 1 FROM r JOIN merged m ON m.child = r.node),
    n AS (SELECT tip, node, min(depth) AS depth FROM r GROUP BY tip, node),
    j AS (SELECT a, b, x.node, row_number() OVER (PARTITION BY a, b ORDER BY x.depth + y.depth, x.node) AS k FROM pairs JOIN n x ON x.tip = a JOIN n y ON y.tip = b AND y.node = x.node)
    SELECT a, b, node AS base FROM j WHERE k = 1""",
)
def merge_base_merged(spark, d):
    from pyspark.sql import Window

    parents, ends = merged_history(spark, d)
    # Neighbouring customers; the list of customers is small beside their orders.
    pairs = ends.select(F.col("b").alias("a"), F.lead("b").over(Window.orderBy("o_custkey")).alias("b")).where("b IS NOT NULL")
    return dag.merge_base(parents, materialize(pairs, "pairs"))


@query(
    "topo_levels",
    f"""WITH RECURSIVE {SUCCESSOR}, d AS (SELECT src AS node, dst AS needs FROM succ), n AS (SELECT node FROM d UNION SELECT needs FROM d),
    w AS (SELECT node AS origin, needs AS node FROM d UNION SELECT w.origin, d.needs FROM w JOIN d ON d.node = w.node),
    bad AS (SELECT DISTINCT w.origin FROM w WHERE w.node IN (SELECT origin FROM w v WHERE v.origin = v.node))
    SELECT n.node, CASE WHEN n.node NOT IN (SELECT origin FROM bad) THEN CAST((SELECT count(*) FROM w WHERE w.origin = n.node) AS INTEGER) END AS level FROM n""",
)
def topo_levels(spark, d):
    return dag.topo_levels(materialize(main_successor(spark, d), "succ").select(F.col("src").alias("node"), F.col("dst").alias("needs")))


@query(
    "topo_levels_acyclic",
    f"""WITH RECURSIVE {SUCCESSOR}, d AS (SELECT src AS node, dst AS needs FROM succ WHERE src < dst), n AS (SELECT node FROM d UNION SELECT needs FROM d),
    w AS (SELECT node AS origin, needs AS node FROM d UNION SELECT w.origin, d.needs FROM w JOIN d ON d.node = w.node)
    SELECT n.node, CAST((SELECT count(*) FROM w WHERE w.origin = n.node) AS INTEGER) AS level FROM n""",
)
def topo_levels_acyclic(spark, d):
    deps = main_successor(spark, d).where("src < dst").select(F.col("src").alias("node"), F.col("dst").alias("needs"))
    return dag.topo_levels(deps)


@query(
    "topo_levels_all",
    f"""WITH RECURSIVE {PART_STEPS}, d AS (SELECT a AS node, b AS needs FROM steps WHERE a < b), n AS (SELECT node FROM d UNION SELECT needs FROM d),
    l AS (SELECT node, 0 AS level FROM n UNION SELECT d.node, l.level + 1 FROM l JOIN d ON d.needs = l.node)
    SELECT node, max(level) AS level FROM l GROUP BY node""",
)
def topo_levels_all(spark, d):
    """Every edge between parts, from the smaller to the larger key."""
    deps = materialize(part_steps(spark, d).where("a < b").select(F.col("a").alias("node"), F.col("b").alias("needs")), "deps")
    return dag.topo_levels(deps)


# Symbols of a document: lines that start with a capitalised ASCII word.
SYMBOL = {"declaration_re": r"(?m)^([A-Z][a-z]+)(?![A-Za-z0-9_])", "name_group": 1, "behavioural": ("[^,]*,",)}
WORDS = {"identifier_re": "[A-Za-z0-9_]+"}
SYMBOLS = """l AS (SELECT doc_id AS doc, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+([^A-Za-z0-9_]|$)') THEN line_no END AS own FROM l),
g AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sym FROM h),
s AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY sym) AS i, string_agg(line, chr(10) ORDER BY line_no) AS body FROM g WHERE sym IS NOT NULL GROUP BY doc, sym),
sy AS (SELECT doc, i, regexp_extract(body, '^[A-Z][a-z]+') AS name, list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+')) AS words, contains(body, ',') AS behavioral FROM s)"""
COHESION = f"""{SYMBOLS}, e AS (SELECT x.doc * 1000000 + x.i AS a, x.doc * 1000000 + y.i AS b FROM sy x JOIN sy y ON x.doc = y.doc AND x.i <> y.i AND list_contains(x.words, y.name)),
{COMPONENTS},
coh AS (SELECT doc, count(*) AS symbols, count(CASE WHEN behavioral THEN 1 END) AS behavioral,
    count(*) - (SELECT count(*) FROM comp WHERE node // 1000000 = sy.doc AND node <> component) AS components FROM sy GROUP BY doc)"""


@query(
    "cohesion",
    f"""WITH RECURSIVE {COHESION} SELECT documents.doc_id AS doc, coalesce(symbols, 0) AS symbols, coalesce(behavioral, 0) AS behavioral, coalesce(components, 0) AS components,
      round(CASE WHEN symbols >= 2 THEN 1 - (components - 1) / (symbols - 1) END, 6) AS cohesion FROM documents LEFT JOIN coh ON coh.doc = doc_id""",
)
def cohesion(spark, d):
    return graph.cohesion(table(spark, d, "documents"), **WORDS, **SYMBOL).withColumn("cohesion", F.round("cohesion", 6))


GOD = f"""{DOCS}, {PROFILE}, {COHESION},
j AS (SELECT docs.doc_id, loc, CASE WHEN symbols >= 2 THEN 1 - (components - 1) / (symbols - 1) END AS cohesion, coalesce(behavioral, 0) AS behavioral,
    CAST(regexp_matches(text, '[0-9]') AS BIGINT) + CAST(regexp_matches(text, '!!') AS BIGINT) + CAST(regexp_matches(text, '@') AS BIGINT) + CAST(regexp_matches(text, 'Licen[sc]e') AS BIGINT) AS cats
  FROM docs LEFT JOIN coh ON coh.doc = docs.doc_id),
god AS (SELECT doc_id, loc, cats, CASE WHEN cats >= 2 AND loc > threshold AND (cohesion IS NULL OR cohesion < 0.9) THEN 'mixing+size' WHEN cats >= 2 THEN 'mixing'
    WHEN loc > threshold AND cohesion IS NULL THEN 'size' WHEN loc > threshold AND cohesion < 0.9 THEN 'size+low-cohesion' END AS reason FROM j, lim)"""


def _measured(spark, d):
    from plumbline.operators.profile import categories

    t = sized_docs(spark, d)
    rules = [("digits", "[0-9]"), ("shout", "!!"), ("mail", "@"), ("license", "Licen[sc]e")]
    coh = graph.cohesion(table(spark, d, "documents"), **WORDS, **SYMBOL).withColumnRenamed("doc", "doc_id")
    return t.withColumn("cats", F.size(categories(F.array("text"), rules)).cast("bigint")).drop("text").join(coh, "doc_id", "left")


@query("god_docs", f"WITH RECURSIVE {GOD} SELECT doc_id, loc, cats, reason FROM god WHERE reason IS NOT NULL")
def god_docs(spark, d):
    return profile.god_docs(materialize(_measured(spark, d), "measured"), min_cats=2, low=0.9).select("doc_id", "loc", "cats", "reason")


@query(
    "low_cohesion",
    f"""WITH RECURSIVE {GOD} SELECT j.doc_id, round(cohesion, 6) AS cohesion FROM j JOIN god USING (doc_id) WHERE reason IS NULL AND cohesion < 0.9 AND behavioral >= 3""",
)
def low_cohesion(spark, d):
    m = materialize(_measured(spark, d), "measured")
    flagged = profile.god_docs(m, min_cats=2, low=0.9)
    return profile.low_cohesion(m, flagged, low=0.9, min_behavioral=3).select("doc_id", F.round("cohesion", 6).alias("cohesion"))


@query(
    "barrels",
    f"""WITH p AS (SELECT page_id, 'export ' || CASE page_id % 3 WHEN 0 THEN '* from "./a"' WHEN 1 THEN '{{ b }} from "./b"' ELSE 'const c = 1' END || chr(10)
      || CASE WHEN contains(html, '<ul>') AND page_id % 2 = 0 THEN 'function f() {{}}' ELSE 'const v = 2' END AS text FROM pages)
    SELECT page_id FROM p WHERE page_id % 3 <> 2 AND NOT contains(text, 'function')""",
)
def barrels(spark, d):
    n = F.col("page_id")
    text = F.concat(
        F.lit("export "),
        F.when(n % 3 == 0, '* from "./a"').when(n % 3 == 1, '{ b } from "./b"').otherwise("const c = 1"),
        F.lit("\n"),
        F.when(F.contains("html", F.lit("<ul>")) & (n % 2 == 0), "function f() {}").otherwise("const v = 2"),
    )
    pages = table(spark, d, "pages").select("page_id", text.alias("text"))
    return graph.barrels(pages, graph.symbols(pages, "page_id"), "page_id")


@query(
    "symbols",
    f"""WITH {SYMBOLS} SELECT doc, name, count(*) AS n FROM sy GROUP BY ALL""",
)
def symbols(spark, d):
    return graph.symbols(table(spark, d, "documents"), **SYMBOL).groupBy("doc", "name").agg(F.count(F.lit(1)).alias("n"))
