"""Change-log mining: churn, ownership concentration, co-change rules, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.records import clamp, round_half_up
from plumbline.plans.lineage import materialize
from plumbline.plans.skew import HEAVY_KEYS, salted_join

# Defaults of the change-log lenses.
CHURN_DAYS = 180
MIN_CHURN = 2
BUS_FACTOR_TOP = 20
BUS_FACTOR_MIN_COMMITS = 4
CAP_PERCENTILE = 0.95
CAP_FLOOR = 15
CAP_CEILING = 50
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
GROUP_MIN_SUPPORT = 4
OUT_PAIRS = 15
FOLLOWUP_DAYS = 30


def in_window(changes: DataFrame, ts: str = "ts", days: int = CHURN_DAYS, as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (default: the newest row).

    The bound is a scalar subquery, so it reaches the scan as a plain filter.
    """
    end = as_of if as_of is not None else changes.agg(F.max(ts).alias("end")).scalar()
    return changes.where(F.col(ts) >= end - F.expr(f"INTERVAL {days} DAYS"))


def churn(
    changes: DataFrame, item: str = "item", ts: str = "ts", days: int = CHURN_DAYS, minimum: int = MIN_CHURN
) -> DataFrame:
    """``item, commits``: appearances in the window."""
    return (
        in_window(changes, ts, days)
        .groupBy(item)
        .agg(F.count(F.lit(1)).alias("commits"))
        .where(F.col("commits") >= minimum)
    )


def bus_factor(
    changes: DataFrame,
    item: str = "item",
    actor: str = "actor",
    ts: str = "ts",
    days: int = CHURN_DAYS,
    top: int | None = None,
    min_commits: int = BUS_FACTOR_MIN_COMMITS,
) -> DataFrame:
    """``item, commits, actors, top_share`` of every item with enough commits; a report may ask for the ``top`` hottest.

    One pass: counts per (item, actor) combine map-side and roll up per item, so
    the ranking and the shares come from the same aggregate.
    """
    per_actor = in_window(changes, ts, days).groupBy(item, actor).agg(F.count(F.lit(1)).alias("n"))
    per_item = per_actor.groupBy(item).agg(
        F.sum("n").alias("commits"), F.count(F.lit(1)).alias("actors"), F.max("n").alias("_top")
    )
    hottest = per_item.where(F.col("commits") >= MIN_CHURN)
    if top is not None:
        hottest = hottest.orderBy(F.col("commits").desc(), F.col(item).asc()).limit(top)
    return hottest.where(F.col("commits") >= min_commits).select(
        item, "commits", "actors", (F.col("_top") / F.col("commits")).alias("top_share")
    )


def basket_sizes(changes: DataFrame, basket: str = "basket_id", item: str = "item") -> DataFrame:
    return changes.select(basket, item).distinct().groupBy(basket).agg(F.count(F.lit(1)).alias("size"))


def adaptive_cap(
    sizes: DataFrame, q: float = CAP_PERCENTILE, floor: int = CAP_FLOOR, ceiling: int = CAP_CEILING
) -> DataFrame:
    """``cap`` in one row: the clamped percentile of basket sizes, from their histogram."""
    hist = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    p = F.coalesce(round_half_up(F.expr(f"percentile(size, {q}, n)")), F.lit(0))
    return hist.agg(clamp(p, floor, ceiling).alias("cap"))


def capped_baskets(
    changes: DataFrame, basket: str = "basket_id", item: str = "item", **cap: float
) -> DataFrame:
    """``basket_id, items``: distinct sorted items of every basket that is not a bulk basket.

    Bulk baskets carry no coupling signal and are excluded by definition. They
    are recognised by a count first, so a list is only built for baskets of at
    most ``cap`` items.
    """
    rows = changes.select(F.col(basket).alias("basket_id"), F.col(item).alias("item")).distinct()
    sizes = rows.groupBy("basket_id").agg(F.count(F.lit(1)).alias("size"))
    limit = adaptive_cap(sizes, **cap).scalar()
    kept = sizes.where(F.col("size") <= limit).select("basket_id")
    # The largest bulk baskets (a bounded list) leave before rows are shuffled by basket.
    bulk = sizes.where(F.col("size") > limit).orderBy(F.col("size").desc(), "basket_id").limit(HEAVY_KEYS).select("basket_id")
    rows = rows.join(F.broadcast(bulk), "basket_id", "left_anti")
    return rows.join(kept, "basket_id").groupBy("basket_id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def basket_pairs(baskets: DataFrame) -> DataFrame:
    """``a, b, support`` over all baskets; at most ``cap * (cap - 1) / 2`` pairs come from one basket."""
    pairs = F.flatten(
        F.transform(
            "items",
            lambda a, i: F.transform(
                F.slice(F.col("items"), i + F.lit(2), F.size("items")), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    return (
        baskets.where(F.size("items") > 1)
        .select(F.explode(pairs).alias("p"))
        .groupBy("p.a", "p.b")
        .agg(F.count(F.lit(1)).alias("support"))
    )


def co_change(
    changes: DataFrame,
    basket: str = "basket_id",
    item: str = "item",
    min_support: int = MIN_SUPPORT,
    min_conf: float = MIN_CONFIDENCE,
    ts: str | None = None,
    days: int = CHURN_DAYS,
    **cap: float,
) -> DataFrame:
    """``a, b, support, conf, driver, follower`` for every surviving pair (a < b).

    With ``ts`` only changes of the last ``days`` days count, as in ``churn``.

    ``conf`` is support over the changes of the side that changes less; the
    driver is the side with the higher confidence, ``a`` on a tie. Bulk baskets
    count neither in the support nor in the changes.
    """
    # Stored once: both the changes per item and the pairs come from the baskets.
    recent = changes if ts is None else in_window(changes, ts, days)
    baskets = materialize(capped_baskets(recent, basket, item, **cap), "baskets")
    totals = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    pairs = basket_pairs(baskets).where(F.col("support") >= min_support)
    ta = totals.select(F.col("item").alias("a"), F.col("n").alias("na"))
    tb = totals.select(F.col("item").alias("b"), F.col("n").alias("nb"))
    scored = pairs.join(ta, "a").join(tb, "b")
    ab, ba = F.col("support") / F.col("na"), F.col("support") / F.col("nb")
    return (
        scored.withColumn("conf", F.greatest(ab, ba))
        .where(F.col("conf") >= min_conf)
        .select(
            "a",
            "b",
            "support",
            "conf",
            F.when(ab >= ba, F.col("a")).otherwise(F.col("b")).alias("driver"),
            F.when(ab >= ba, F.col("b")).otherwise(F.col("a")).alias("follower"),
        )
    )


def hidden_only(pairs: DataFrame, edges: DataFrame, hubs: DataFrame, hub: str = "item") -> DataFrame:
    """Drop pairs with an explicit edge either way, or with a re-export hub at either end."""
    undirected = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = hubs.select(F.col(hub)).distinct()
    return (
        pairs.join(undirected, ["a", "b"], "left_anti")
        .join(ends.withColumnRenamed(hub, "a"), "a", "left_anti")
        .join(ends.withColumnRenamed(hub, "b"), "b", "left_anti")
        .select(*pairs.columns)
    )


def strongest(pairs: DataFrame, n: int = OUT_PAIRS) -> DataFrame:
    """Report list of the strongest pairs."""
    return pairs.orderBy(F.col("support").desc(), F.col("conf").desc(), "a", "b").limit(n)


def followups(
    precedents: DataFrame,
    fixes: DataFrame,
    key: str,
    ts: str = "ts",
    days: int = FOLLOWUP_DAYS,
    minimum: int = 2,
) -> DataFrame:
    """``key, precedents, followed``: earlier changes with a later fix on the same key within ``days``.

    Keys with at least ``minimum`` followed precedents qualify for a severity
    bump. Fixes are summarised per (key, day): a change is followed if the day's
    last fix is later, or if the first fix of the next day that has one lies
    within the span. The window therefore runs over days, not over rows, and
    a hot key costs one summary row per day.
    """
    micros = days * 86_400_000_000
    day = F.floor(F.col("t") / 86_400_000_000).cast("bigint")

    def instants(frame: DataFrame) -> DataFrame:
        return frame.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).withColumn("day", day)

    changed, fixed = instants(precedents), instants(fixes)
    summary = (
        fixed.select(key, "day", "t")
        .unionByName(changed.select(key, "day", F.lit(None).cast("bigint").alias("t")))
        .groupBy(key, "day")
        .agg(F.min("t").alias("first_fix"), F.max("t").alias("last_fix"))
    )
    later = Window.partitionBy(key).orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    summary = summary.withColumn("next_fix", F.first("first_fix", ignorenulls=True).over(later))
    marked = salted_join(changed, summary, [key, "day"], spread_by=[F.col("t")]).withColumn(
        "hit",
        F.coalesce(F.col("last_fix") > F.col("t"), F.lit(False))
        | F.coalesce(F.col("next_fix") <= F.col("t") + micros, F.lit(False)),
    )
    return (
        marked.groupBy(key)
        .agg(F.count(F.lit(1)).alias("precedents"), F.sum(F.col("hit").cast("bigint")).alias("followed"))
        .where(F.col("followed") >= minimum)
    )
