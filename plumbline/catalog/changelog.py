"""Change-log queries: orders as commits, suppliers as items; events as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.catalog.derived import FINDINGS, event_changes, findings, supply_changes
from plumbline.operators import changelog
from plumbline.operators import findings as fnd
from plumbline.plans.layout import pieces

WINDOWED = "w AS (SELECT user_id AS item, event_type AS actor, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY)"


@query("churn", f"WITH {WINDOWED} SELECT item, count(*) AS commits FROM w GROUP BY item HAVING count(*) >= 20")
def churn(spark, d):
    return changelog.churn(event_changes(spark, d), days=14, minimum=20)


@query(
    "bus_factor",
    f"""WITH {WINDOWED}, a AS (SELECT item, actor, count(*) AS n FROM w GROUP BY ALL),
    i AS (SELECT item, CAST(sum(n) AS BIGINT) AS commits, count(*) AS actors, max(n) AS top FROM a GROUP BY item)
    SELECT item, commits, actors, round(top / commits, 6) AS top_share FROM i ORDER BY commits DESC, item LIMIT 20""",
)
def bus_factor(spark, d):
    return changelog.bus_factor(event_changes(spark, d), days=14, top=changelog.BUS_FACTOR_TOP).withColumn("top_share", F.round("top_share", 6))


@query(
    "bus_factor_all",
    f"""WITH {WINDOWED}, a AS (SELECT item, actor, count(*) AS n FROM w GROUP BY ALL),
    i AS (SELECT item, CAST(sum(n) AS BIGINT) AS commits, count(*) AS actors, max(n) AS top FROM a GROUP BY item)
    SELECT item, commits, actors, round(top / commits, 6) AS top_share FROM i WHERE commits >= 4""",
)
def bus_factor_all(spark, d):
    return changelog.bus_factor(event_changes(spark, d), days=14).withColumn("top_share", F.round("top_share", 6))


BASKETS = """rows AS (SELECT DISTINCT l_orderkey AS basket_id, l_suppkey AS item FROM lineitem),
sizes AS (SELECT basket_id, count(*) AS size FROM rows GROUP BY basket_id),
cap AS (SELECT least(6, greatest(3, CAST(floor(quantile_cont(size, 0.95) + 0.5) AS BIGINT))) AS cap FROM sizes)"""
CAP = {"floor": 3, "ceiling": 6}


@query("adaptive_cap", f"WITH {BASKETS} SELECT cap, (SELECT count(*) FROM sizes WHERE size > cap) AS bulk FROM cap")
def adaptive_cap(spark, d):
    sizes = changelog.basket_sizes(supply_changes(spark, d))
    cap = changelog.adaptive_cap(sizes, **CAP).scalar()
    return sizes.agg(F.max(cap).alias("cap"), F.count(F.when(F.col("size") > cap, 1)).alias("bulk"))


PAIRS = f"""{BASKETS}, kept AS (SELECT r.basket_id, r.item FROM rows r JOIN sizes USING (basket_id), cap WHERE size <= cap),
totals AS (SELECT item, count(*) AS n FROM kept GROUP BY item),
raw AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM kept x JOIN kept y ON x.basket_id = y.basket_id AND x.item < y.item GROUP BY ALL),
pairs AS (SELECT a, b, support, greatest(support / ta.n, support / tb.n) AS conf,
    CASE WHEN support / ta.n >= support / tb.n THEN a ELSE b END AS driver, CASE WHEN support / ta.n >= support / tb.n THEN b ELSE a END AS follower
  FROM raw JOIN totals ta ON ta.item = a JOIN totals tb ON tb.item = b WHERE support >= 3 AND greatest(support / ta.n, support / tb.n) >= 0.04)"""


def _pairs(spark, d):
    return changelog.co_change(supply_changes(spark, d), min_conf=0.04, **CAP)


@query("co_change", f"WITH {PAIRS} SELECT a, b, support, round(conf, 6) AS conf, driver, follower FROM pairs")
def co_change(spark, d):
    return _pairs(spark, d).withColumn("conf", F.round("conf", 6))


RECENT = PAIRS.replace("FROM lineitem)", "FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY)", 1)


@query("co_change_window", f"WITH {RECENT} SELECT a, b, support, round(conf, 6) AS conf, driver, follower FROM pairs")
def co_change_window(spark, d):
    """Pairs of the last 900 days, counted back from the newest order."""
    return changelog.co_change(recent_changes(spark, d), min_conf=0.04, ts="ts", days=900, **CAP).withColumn("conf", F.round("conf", 6))


def recent_changes(spark, d):
    """``basket_id, item, ts`` of the last 900 days; joined and made distinct in pieces of bounded size."""
    dates = table(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderdate").alias("ts"))
    newest = dates.agg(F.max("ts").alias("end")).scalar()
    recent = changelog.in_window(dates, "ts", 900, as_of=newest)
    lines = supply_changes(spark, d)
    n = pieces(lines.count())
    return lines.repartition(n, "basket_id").join(recent.repartition(n, "basket_id"), "basket_id")


HIDDEN = f"""{PAIRS}, near AS (SELECT DISTINCT least(x.l_suppkey, y.l_suppkey) AS a, greatest(x.l_suppkey, y.l_suppkey) AS b FROM lineitem x
    JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 AND y.l_shipdate = x.l_shipdate),
  hub AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0),
  hidden AS (SELECT * FROM pairs WHERE (a, b) NOT IN (SELECT a, b FROM near) AND a NOT IN (SELECT s_suppkey FROM hub) AND b NOT IN (SELECT s_suppkey FROM hub))"""


def hidden(spark, d):
    """Suppliers of two lines in a row that were shipped on one day are linked."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    x = li.select("l_orderkey", "l_shipdate", F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("src"))
    y = li.select("l_orderkey", "l_shipdate", (F.col("l_linenumber") - 1).alias("k"), F.col("l_suppkey").alias("dst"))
    edges = x.join(y, ["l_orderkey", "l_shipdate", "k"]).select("src", "dst").distinct()
    hubs = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("item"))
    return changelog.hidden_only(_pairs(spark, d), edges, hubs)


@query("hidden_only", f"WITH {HIDDEN} SELECT a, b, support FROM hidden")
def hidden_only(spark, d):
    return hidden(spark, d).select("a", "b", "support")


@query("strongest_pairs", f"WITH {HIDDEN} SELECT a, b, support, round(conf, 6) AS conf FROM hidden ORDER BY support DESC, conf DESC, a, b LIMIT 15")
def strongest_pairs(spark, d):
    return changelog.strongest(hidden(spark, d)).select("a", "b", "support", F.round("conf", 6).alias("conf"))


FOLLOWED = """f AS (SELECT o_custkey AS item, count(*) AS precedents, count(CASE WHEN EXISTS (
    SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderstatus = 'F' AND n.o_orderdate > o.o_orderdate AND n.o_orderdate <= o.o_orderdate + INTERVAL 30 DAY) THEN 1 END) AS followed
  FROM orders o WHERE o_orderstatus <> 'F' GROUP BY o_custkey)"""


def _followups(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderdate").alias("ts"), "o_orderstatus")
    return changelog.followups(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), "item")


@query("followups", f"WITH {FOLLOWED} SELECT item, precedents, followed FROM f WHERE followed >= 2")
def followups(spark, d):
    return _followups(spark, d)


@query(
    "event_followups",
    """WITH f AS (SELECT user_id, count(*) AS precedents, count(CASE WHEN EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'purchase'
        AND n.ts > e.ts AND n.ts <= e.ts + INTERVAL 1 DAY) THEN 1 END) AS followed FROM events e WHERE event_type = 'error' GROUP BY user_id)
    SELECT user_id, precedents, followed FROM f WHERE followed >= 2""",
)
def event_followups(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_type")
    return changelog.followups(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", days=1)




@query(
    "precedent_bump",
    f"""WITH {FINDINGS}, {FOLLOWED}, b AS (SELECT item FROM f WHERE followed >= 2)
    SELECT id, CASE WHEN item IS NULL THEN severity ELSE CASE severity WHEN 'Low' THEN 'Med' WHEN 'Med' THEN 'High' WHEN 'discuss' THEN 'suggestion'
      WHEN 'suggestion' THEN 'important' WHEN 'important' THEN 'critical' ELSE severity END END AS severity, item IS NOT NULL AS precedent_weighted
    FROM findings LEFT JOIN b ON item = n""",
)
def precedent_bump(spark, d):
    f = findings(spark, d).withColumn("item", F.substring("id", 2, 20).cast("bigint"))
    return fnd.precedent_bump(f, _followups(spark, d), "item").select("id", "severity", "precedent_weighted")
