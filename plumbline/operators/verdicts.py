"""Decision tables over the other operators' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lens predicates' limits and the bands.
ENVY_RATIO = 0.7
ENVY_OWN = 2
ENVY_CONFIRMED = 3
STRUCTURAL_PAIRS = 3
RIPPLE_COMMAS = 2
SWALLOW_DOCS = 2
SWALLOW_HABIT = 3
FULL_DOCS = 100
FULL_LENSES = 4
LENS_ORDER = ["G", "Lc", "D", "C", "A", "S", "Fe", "T", "Tc", "Fp"]
CROSS_CUTTING = ["C", "A", "T", "S", "Fe", "Fp"]
ALWAYS_ON = ["M", "L"]
FULL_DISPATCH = ["C", "A", "T", "L", "M", "S", "Fe", "Fp"]


def warrant(
    blocks: DataFrame, file_count: Column, pre_release: bool = False, owner_none: int = 0, dead_known: int | None = None, coverage_gaps: int = 0
) -> DataFrame:
    """``file_count, live, unmeasured, band, dispatch`` in one row.

    ``blocks(label, line)`` has a NULL line for an empty block, so a block that
    ran without findings differs from one that did not run. All ten lens
    predicates are conditional aggregates of a single pass.
    """
    line, label = F.col("line"), F.col("label")
    number = lambda pattern: F.coalesce(
        F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast("double"), F.lit(0.0)
    )
    rows = lambda name: F.count(F.when(label == name, line))
    ran = lambda name: F.coalesce(F.bool_or(label == name), F.lit(False))
    some = lambda name, cond: F.coalesce(F.bool_or((label == name) & line.isNotNull() & cond), F.lit(False))
    one = blocks.agg(
        (rows("godfile-candidates") >= 1).alias("G"),
        (rows("low-cohesion") >= 1).alias("Lc"),
        (some("dup-candidates", line.rlike("via=(lines|both)")) | (rows("dup-candidates") >= STRUCTURAL_PAIRS)).alias("D"),
        F.when(ran("type-fragmentation-semantic"), rows("type-fragmentation-semantic") >= 1).alias("C"),
        (
            F.lit(dead_known >= 1)
            if dead_known is not None
            else F.when(ran("dead-exports-semantic"), rows("dead-exports-semantic") >= 1).otherwise(
                some("export-usage", line.rlike(r"(?<![A-Za-z0-9_])inbound=0(?![A-Za-z0-9_])"))
            )
        ).alias("A"),
        (
            F.lit(owner_none >= 1)
            | F.when(
                ran("write-sites-semantic"), some("write-sites-semantic", number(r"writers=(\d+)") >= 2)
            ).otherwise(some("write-sites", number(r"writers=(\d+)") >= 2))
        ).alias("S"),
        F.when(
            ran("feature-envy-semantic"), some("feature-envy-semantic", number(r"behavioralRefs=(\d+)") >= ENVY_CONFIRMED)
        )
        .otherwise(
            some("feature-envy-candidates", (number(r"ratio=([\d.]+)") >= ENVY_RATIO) & (number(r"own=(\d+)") >= ENVY_OWN))
        )
        .alias("Fe"),
        ((rows("test-density") >= 1) | F.lit(coverage_gaps >= 1)).alias("T"),
        some("co-change-groups", F.regexp_count(line, F.lit(",")) >= RIPPLE_COMMAS).alias("Tc"),
        (
            (rows("catch-swallows") >= SWALLOW_DOCS) | some("catch-swallows", number(r"swallows=(\d+)") >= SWALLOW_HABIT)
        ).alias("Fp"),
    )
    return band(one.withColumn("file_count", file_count), pre_release)


def band(lenses: DataFrame, pre_release: bool = False) -> DataFrame:
    """Three-band decision over boolean lens columns and ``file_count``."""
    pick = lambda names, cond: F.array_compact(F.array(*[F.when(cond(F.col(n)), F.lit(n)) for n in names]))
    live = pick(LENS_ORDER, lambda c: F.coalesce(c, F.lit(False)))
    unmeasured = pick(LENS_ORDER, lambda c: c.isNull())
    out = lenses.withColumn("live", live).withColumn("unmeasured", unmeasured)
    decision = (
        F.when((F.col("file_count") >= FULL_DOCS) | F.lit(pre_release) | (F.size("live") >= FULL_LENSES), "full")
        .when(F.size("live") >= 1, "selective")
        .otherwise("skip")
    )
    out = out.withColumn("band", decision)
    chosen = F.concat(F.filter("live", lambda l: l.isin(CROSS_CUTTING)), F.array(*[F.lit(x) for x in ALWAYS_ON]))
    dispatch = (
        F.when(F.col("band") == "full", F.array(*[F.lit(x) for x in FULL_DISPATCH]))
        .when(F.col("band") == "selective", chosen)
        .otherwise(F.array().cast("array<string>"))
    )
    return out.withColumn("dispatch", dispatch).select("file_count", "live", "unmeasured", "band", "dispatch")


def scorecard(metrics: DataFrame, thresholds: dict[str, tuple[float, float]], composite: str | None = None) -> DataFrame:
    """``signal, value, baseline, verdict``: a long table from one row of metric columns.

    ``thresholds`` gives (watch, hot) per signal; a NULL value has no verdict.
    The composite is a supplied label and is passed through.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(s).alias("signal"),
                F.col(s).cast("double").alias("value"),
                F.lit(watch).cast("double").alias("baseline"),
                F.when(F.col(s).isNull(), F.lit("n/a"))
                .when(F.col(s) > hot, F.lit("hot"))
                .when(F.col(s) > watch, F.lit("watch"))
                .otherwise(F.lit("ok"))
                .alias("verdict"),
            )
            for s, (watch, hot) in thresholds.items()
        ]
    )
    rows = metrics.select(F.explode(cells).alias("c")).select("c.*")
    if composite is None:
        return rows
    last = metrics.select(
        F.lit("composite").alias("signal"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("double").alias("baseline"),
        F.lit(composite).alias("verdict"),
    )
    return rows.unionByName(last)


def priority_distribution(cases: DataFrame, priority: str = "priority") -> DataFrame:
    """``priority, cases, percentage`` with whole-number percentages."""
    counts = cases.groupBy(priority).agg(F.count(F.lit(1)).alias("cases"))
    total = cases.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("percentage", F.floor(F.col("cases") * 100.0 / total + 0.5).cast("bigint"))


def coverage_totals(cases: DataFrame, outer: str, inner: str, minutes: str | None = None, smoke: str | None = None) -> DataFrame:
    """``outer, inner, cases, smoke, minutes`` on two granularities (NULL inner: total of the outer)."""
    return cases.groupBy(outer, inner).agg(
        F.count(F.lit(1)).alias("cases"),
        (F.count(F.when(F.col(smoke), 1)) if smoke else F.lit(0).cast("bigint")).alias("smoke"),
        (F.sum(minutes) if minutes else F.lit(0).cast("bigint")).alias("minutes"),
    ).rollup(outer, inner).agg(
        F.sum("cases").alias("cases"), F.sum("smoke").alias("smoke"), F.sum("minutes").alias("minutes")
    ).where(F.col(outer).isNotNull())
