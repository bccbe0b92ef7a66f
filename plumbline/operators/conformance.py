"""Declared models against actual edges: coverage, aspirations, layers, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators.graph import strongly_connected
from plumbline.operators.references import longest_prefix_map
from plumbline.plans.lineage import materialize


def element_prefixes(elements: DataFrame) -> DataFrame:
    """``prefix, owner`` rows of ``elements(fqn, prefixes)``."""
    return elements.select(F.explode("prefixes").alias("prefix"), F.col("fqn").alias("owner")).where(F.length("prefix") > 0)


def map_edges(edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``src, dst, a, b``: owners of both ends (NULL when unmapped).

    Nodes are mapped once each, not once per edge.
    """
    nodes = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    # Both ends look up the same table; it is worked out once.
    owned = materialize(longest_prefix_map(nodes, prefixes).select("path", "owner"), "owners")
    return (
        edges.select("src", "dst")
        .join(owned.select(F.col("path").alias("src"), F.col("owner").alias("a")), "src", "left")
        .join(owned.select(F.col("path").alias("dst"), F.col("owner").alias("b")), "dst", "left")
        .select("src", "dst", "a", "b")
    )


def owner_pairs(mapped: DataFrame) -> DataFrame:
    """``a, b, n, sample``: edges between different owners, counted."""
    return (
        mapped.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("src", "dst")).alias("s"))
        .select("a", "b", "n", F.concat_ws(" -> ", "s.src", "s.dst").alias("sample"))
    )


def credited(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """``a, b, n, sample, credit_src, credit_dst``: the declared relation covering each owner pair.

    Ancestors of both ends are tried, nearest source first, then nearest
    target; the credit is NULL when no pair of ancestors is declared.
    """
    chains = pairs.select(
        "a",
        "b",
        F.posexplode(paths.dotted_chain(F.col("a"))).alias("i", "src"),
    ).select("a", "b", "i", "src", F.posexplode(paths.dotted_chain(F.col("b"))).alias("j", "dst"))
    declared = relations.select("src", "dst").distinct()
    hit = chains.join(declared, ["src", "dst"]).groupBy("a", "b").agg(
        F.min_by(F.struct("src", "dst"), F.struct("i", "j")).alias("c")
    )
    return pairs.join(hit, ["a", "b"], "left").select(
        "a", "b", "n", "sample", F.col("c.src").alias("credit_src"), F.col("c.dst").alias("credit_dst")
    )


def undocumented(credits: DataFrame) -> DataFrame:
    """``a, b, n, sample``: owner pairs with edges and no covering declaration."""
    return credits.where(F.col("credit_src").isNull()).select("a", "b", "n", "sample")


def aspirational(relations: DataFrame, credits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``src, dst, title``: declared relations between code-backed elements that no edge is credited to."""
    backed = prefixes.select(F.explode(paths.dotted_chain(F.col("owner"))).alias("name")).distinct()
    used = credits.where(F.col("credit_src").isNotNull()).select(
        F.col("credit_src").alias("src"), F.col("credit_dst").alias("dst")
    ).distinct()
    return (
        relations.join(backed.withColumnRenamed("name", "src"), "src", "left_semi")
        .join(backed.withColumnRenamed("name", "dst"), "dst", "left_semi")
        .join(used, ["src", "dst"], "left_anti")
        .select("src", "dst", "title")
    )


def unmapped(mapped: DataFrame) -> DataFrame:
    """Distinct paths at unmapped ends."""
    ends = mapped.where(F.col("a").isNull()).select(F.col("src").alias("path")).unionByName(
        mapped.where(F.col("b").isNull()).select(F.col("dst").alias("path"))
    )
    return ends.distinct()


def conformance_summary(edges: DataFrame, elements: DataFrame, relations: DataFrame) -> DataFrame:
    """``undocumented, aspirational, unmapped, status`` in one row; no edges or elements degrades the check."""
    prefixes = element_prefixes(elements)
    mapped = map_edges(edges, prefixes)
    mapped = materialize(mapped, "mapped")
    credits = credited(owner_pairs(mapped), relations)
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = edges.agg(F.count(F.lit(1)).alias("edges"))
    degraded = (F.col("edges") == 0) | (n(elements) == 0)
    return counts.select(
        F.when(~degraded, n(undocumented(credits))).alias("undocumented"),
        F.when(~degraded, n(aspirational(relations, credits, prefixes))).alias("aspirational"),
        F.when(~degraded, n(unmapped(mapped))).alias("unmapped"),
        F.when(degraded, "degraded").otherwise("ok").alias("status"),
    )


def threshold_gate(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``measure, value, maximum, verdict``: pass or fail per measure; an unknown value skips."""
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value"), F.lit(x).cast("bigint").alias("maximum"))
            for m, x in limits.items()
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select(
        "r.measure",
        "r.value",
        "r.maximum",
        F.when(F.col("r.value").isNull(), "skip").when(F.col("r.value") > F.col("r.maximum"), "fail").otherwise("pass").alias("verdict"),
    )


def layer_breaches(
    edges: DataFrame,
    layers: Sequence[tuple[str, Sequence[str]]],
    forbid: Sequence[tuple[str, str]] = (),
    production_only: bool = True,
    circular: bool = False,
) -> DataFrame:
    """``src, dst, rule``: edges from a layer to a shallower one, and explicitly forbidden edges.

    ``circular`` adds the edges that lie on a cycle, under the rule ``no-circular``.

    ``layers`` lists (name, path prefixes) from layer 0 on. Each layer's
    prefixes are tested in the row, so edges are scanned once and not shuffled.
    An end can lie in several layers when prefixes nest; every upward
    combination counts once per source layer.
    """
    if production_only:
        edges = edges.where(~paths.is_test(F.col("src")) & ~paths.is_test(F.col("dst")))

    def inside(c: Column, prefixes: Sequence[str]) -> Column:
        first, *rest = [c.startswith(p.rstrip("/") + "/") for p in prefixes]
        for cond in rest:
            first = first | cond
        return first

    rules = []
    for k in range(1, len(layers)):
        shallower = [p for _, ps in layers[:k] for p in ps]
        rules.append(F.when(inside(F.col("src"), layers[k][1]) & inside(F.col("dst"), shallower), F.lit(f"no-upward-l{k}")))
    for i, (a, b) in enumerate(forbid, start=1):
        rules.append(F.when(inside(F.col("src"), [a]) & inside(F.col("dst"), [b]), F.lit(f"boundary-{i}")))
    if not rules and not circular:
        raise ValueError("need at least two layers, one forbidden pair or the cycle rule")
    found = [edges.select("src", "dst", F.explode(F.array_compact(F.array(*rules))).alias("rule"))] if rules else []
    if circular:
        found.append(circular_edges(edges).withColumn("rule", F.lit("no-circular")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def circular_edges(edges: DataFrame) -> DataFrame:
    """``src, dst``: distinct edges inside a strongly connected set, and edges of a node to itself."""
    distinct = edges.select("src", "dst").distinct()
    sets = materialize(strongly_connected(distinct), "sets")
    inside = (
        distinct.join(sets.select(F.col("node").alias("src"), F.col("scc").alias("_a")), "src")
        .join(sets.select(F.col("node").alias("dst"), F.col("scc").alias("_b")), "dst")
        .where((F.col("_a") == F.col("_b")) & (F.col("src") != F.col("dst")))
        .select("src", "dst")
    )
    return inside.unionByName(distinct.where(F.col("src") == F.col("dst")))
