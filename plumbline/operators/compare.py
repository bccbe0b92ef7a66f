"""Snapshot comparison, precedence, scope and presence operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions import text as tx
from plumbline.operators import dag

# Which signal speaks for a subject, best first.
PRECEDENCE = {
    "A": ["knip", "dead-exports-semantic", "export-usage"],
    "S": ["write-sites-semantic", "ast-grep", "write-sites"],
    "Fe": ["feature-envy-semantic", "ast-grep", "feature-envy-candidates"],
    "D": ["jscpd", "dup-candidates"],
    "cycles": ["depcruise", "madge"],
}

# Folded tool rows, prefix and severity by category.
FOLD_RULES = {
    ("knip", "exports"): ("K-", "important"),
    ("knip", "files"): ("K-", "suggestion"),
    ("knip", "dependencies"): ("K-", "critical"),
    ("depcruise", "error"): ("DC-", "critical"),
    ("depcruise", "warn"): ("DC-", "important"),
    ("depcruise", "orphan"): ("DC-orphan-", "important"),
    ("stability", "sdp"): ("DC-sdp-", "important"),
    ("layers", "breach"): ("LM-", "important"),
    ("model", "undocumented"): ("C4-undoc-", "important"),
    ("model", "aspirational"): ("C4-aspir-", "suggestion"),
    ("db", "lint"): ("P-", "important"),
    ("db", "drift"): ("P-", "critical"),
}
HEALTH_PREFIX = "CS-"
HEALTH_LIMITS = (7.0, 9.0)


def manifest_diff(old: DataFrame, new: DataFrame, key: Sequence[str], value: str, unchanged: bool = False) -> DataFrame:
    """``key, old, new, change``: Added, Bumped or Removed keyed values (and Unchanged on request)."""
    key = list(key)
    j = old.select(*key, F.col(value).alias("old"), F.lit(1).alias("_o")).join(
        new.select(*key, F.col(value).alias("new"), F.lit(1).alias("_n")), key, "full_outer"
    )
    change = (
        F.when(F.col("_o").isNull(), "Added")
        .when(F.col("_n").isNull(), "Removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "Bumped")
        .otherwise("Unchanged")
    )
    out = j.withColumn("change", change).select(*key, "old", "new", "change")
    return out if unchanged else out.where(F.col("change") != "Unchanged")


def outline_diff(old: DataFrame, new: DataFrame, key: str, attributes: str) -> DataFrame:
    """``key, change``: New, Changed, Removed or Unchanged, comparing attribute sets without order."""
    norm = lambda df: df.select(key, F.sort_array(F.array_distinct(attributes)).alias("value"))
    diff = manifest_diff(norm(old), norm(new), [key], "value", unchanged=True)
    label = F.when(F.col("change") == "Added", "New").when(F.col("change") == "Bumped", "Changed").otherwise(F.col("change"))
    return diff.select(key, label.alias("change"))


def peer_diff(
    peer_rows: DataFrame, new_rows: DataFrame, key: Sequence[str], value: str, exempt: DataFrame | None = None
) -> DataFrame:
    """``key, peer, new, status``: each peer invariant is Mirrored, Diverged, Missing or Intentionally-absent."""
    key = list(key)
    j = peer_rows.select(*key, F.col(value).alias("peer")).join(
        new_rows.select(*key, F.col(value).alias("new"), F.lit(1).alias("_n")), key, "left"
    )
    excused = F.lit(False)
    if exempt is not None:
        j = j.join(exempt.select(*key).distinct().withColumn("_x", F.lit(True)), key, "left")
        excused = F.coalesce("_x", F.lit(False))
    status = (
        F.when(F.col("_n").isNull() & excused, "Intentionally-absent")
        .when(F.col("_n").isNull(), "Missing")
        .when(F.col("peer").eqNullSafe(F.col("new")), "Mirrored")
        .otherwise("Diverged")
    )
    return j.select(*key, "peer", "new", status.alias("status"))


def still_present(evidence: DataFrame, lines: DataFrame, documents: DataFrame, path: str = "path") -> DataFrame:
    """``ev_id, present``: true, false (document or line gone) or NULL (nothing to compare).

    Lines are matched by an equi join on the trimmed text, reduced to the
    distinct (path, line) pairs that are asked for.
    """
    want = evidence.select("ev_id", path, tx.trim_ws(F.col("verbatim")).alias("_line"))
    have = lines.select(path, tx.trim_ws(F.col("line")).alias("_line")).distinct().withColumn("_hit", F.lit(True))
    docs = documents.select(path).distinct().withColumn("_doc", F.lit(True))
    known = F.col(path).isNotNull() & (F.length("_line") > 0)
    return (
        want.join(docs, path, "left")
        .join(have, [path, "_line"], "left")
        .select("ev_id", F.when(known, F.coalesce("_hit", F.lit(False)) & F.coalesce("_doc", F.lit(False))).alias("present"))
    )


def proposals_present(unresolved: DataFrame, documents: DataFrame, tok: str = "tok", path: str = "path") -> DataFrame:
    """``tok, hits, path``: proposed but absent documents that now exist under the same base name.

    The number of documents with that name and the first of them; all of them
    share the base name, so they need not be listed once per token.
    """
    base = unresolved.select(tok, paths.base_of(F.element_at(F.split(tok, ":"), 1)).alias("_base")).distinct()
    named = documents.groupBy(paths.base_of(F.col(path)).alias("_base")).agg(
        F.count(F.lit(1)).alias("hits"), F.min(path).alias(path)
    )
    return base.join(named, "_base").select(tok, "hits", path)


def precedence(signals: DataFrame, order: dict[str, list[str]] = PRECEDENCE, subject: str = "subject", source: str = "source") -> DataFrame:
    """Adds ``authoritative``: the best source that ran for a subject speaks, others corroborate.

    The best rank per subject is an aggregate over the few (subject, source)
    combinations; rows are then tagged by a broadcast of that table.
    """
    rank: Column = F.lit(None).cast("int")
    for name, sources in order.items():
        for i, s in enumerate(sources):
            rank = F.when((F.col(subject) == name) & (F.col(source) == s), F.lit(i)).otherwise(rank)
    ranked = signals.withColumn("_rank", F.coalesce(rank, F.lit(1_000)))
    best = ranked.groupBy(subject).agg(F.min("_rank").alias("_best"))
    return ranked.join(best, subject).withColumn("authoritative", F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def ground_truth_fold(rows: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``id, subject, severity``: tool rows as prefixed, severity-mapped findings.

    ``rows(tool, category, subject)``; ``scores(subject, score)`` adds health
    scores below the upper limit, severe below the lower one.
    """
    prefix: Column = F.lit(None).cast("string")
    severity: Column = F.lit(None).cast("string")
    for (tool, category), (p, s) in FOLD_RULES.items():
        hit = (F.col("tool") == tool) & (F.col("category") == category)
        prefix = F.when(hit, F.lit(p)).otherwise(prefix)
        severity = F.when(hit, F.lit(s)).otherwise(severity)
    out = (
        rows.withColumn("_p", prefix)
        .withColumn("severity", severity)
        .where(F.col("_p").isNotNull())
        .select(F.concat("_p", F.col("subject").cast("string")).alias("id"), F.col("subject").cast("string").alias("subject"), "severity")
    )
    if scores is None:
        return out
    low, high = HEALTH_LIMITS
    unhealthy = scores.where(F.col("score") < high).select(
        F.concat(F.lit(HEALTH_PREFIX), F.col("subject").cast("string")).alias("id"),
        F.col("subject").cast("string").alias("subject"),
        F.when(F.col("score") < low, "critical").otherwise("important").alias("severity"),
    )
    return out.unionByName(unhealthy)


def scope_filter(rows: DataFrame, scope: DataFrame, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """Rows inside an authored scope, and the number dropped (one row ``dropped``)."""
    wanted = scope.select(item).distinct()
    kept = rows.join(wanted, item, "left_semi")
    dropped = rows.join(wanted, item, "left_anti").agg(F.count(F.lit(1)).alias("dropped"))
    return kept, dropped


def resolution_check(claims: DataFrame, parents: DataFrame | None) -> DataFrame:
    """``finding, commit, state, severity``: a claimed fix counts only if its commit is an ancestor of its tip.

    ``claims`` is ``finding, commit, tip, severity``, ``parents`` the history as ``child, parent``. Without a history,
    and for claims without a tip or commit, nothing is verified. Each tip is searched once, no history is closed.
    """
    if parents is None:
        return claims.select("finding", "commit", F.lit("unverified").alias("state"), "severity")
    pairs = claims.select(F.col("commit").alias("a"), F.col("tip").alias("b")).distinct()
    hits = dag.is_ancestor(parents, pairs).where("is_ancestor").select(F.col("a").alias("commit"), F.col("b").alias("tip"), F.lit(True).alias("_hit"))
    j = claims.join(hits, ["commit", "tip"], "left")
    unknown = F.col("tip").isNull() | F.col("commit").isNull()
    return j.select(
        "finding",
        "commit",
        F.when(unknown, "unverified").when(F.col("_hit"), "resolved").otherwise("context only").alias("state"),
        F.when(F.col("_hit"), F.lit("discuss")).otherwise(F.col("severity")).alias("severity"),
    )


def key_coverage(
    keys: DataFrame, tables: DataFrame, presence: DataFrame, key: str = "key", table: str = "tbl"
) -> DataFrame:
    """``key, tbl, problem``: keys a table lacks, and table keys that are no longer in the key set.

    The list of tables is one value inside the plan. Only keys present in fewer
    tables than there are get compared with it, each in its own row.
    """
    names = tables.agg(F.sort_array(F.collect_set(table)).alias("names")).scalar()
    wanted = keys.select(key).distinct()
    have = presence.select(key, table).distinct()
    listed = have.join(tables.select(table).distinct(), table, "left_semi")
    present = listed.groupBy(key).agg(F.collect_set(table).alias("_have"))
    lacking = F.array_except(names, F.coalesce("_have", F.array().cast("array<string>")))
    missing = wanted.join(present, key, "left").select(key, F.explode(lacking).alias(table)).withColumn("problem", F.lit("missing"))
    orphaned = have.join(wanted, key, "left_anti").withColumn("problem", F.lit("orphaned"))
    return missing.select(key, table, "problem").unionByName(orphaned.select(key, table, "problem"))
