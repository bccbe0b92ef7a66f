"""Ranking, carry-forward and budget operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Best ``n`` rows of each group.

    The rank filter sits directly on the window, so each task keeps only its
    own best ``n`` rows per group before the shuffle; a hot group stays cheap.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_k(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def recent(df: DataFrame, ts: str, tie: str, n: int = 10) -> DataFrame:
    """Newest ``n`` rows."""
    return top_k(df, [F.col(ts).desc(), F.col(tie).asc()], n)


def latest_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key. An aggregate, so it combines map-side and tolerates hot keys."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def first_seen(df: DataFrame, tag: str, major: str, minor: str) -> DataFrame:
    """``tag, layer parts, state``: a tag is introduced in its earliest layer, reused in later ones."""
    layers = df.where(F.col(tag).isNotNull()).select(tag, major, minor).distinct()
    earliest = layers.groupBy(tag).agg(F.min(F.struct(major, minor)).alias("_first"))
    return layers.join(earliest, tag).select(
        tag,
        major,
        minor,
        F.when(F.struct(major, minor) == F.col("_first"), F.lit("introduced")).otherwise(F.lit("reused")).alias("state"),
    )


def carry_forward(
    df: DataFrame, key: Sequence[str], order: str, value: str, out: str, block: int = 10_000
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, per key, by the integer column ``order``.

    Done in two levels so that one long sequence spreads over many tasks: each
    block of ``block`` positions reports its last value, those summaries are
    carried along the key, and the fill inside a block starts from the carried
    value.
    """
    key = list(key)
    rows = df.withColumn("_block", F.floor(F.col(order) / block).cast("bigint"))
    summary = rows.groupBy(*key, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
    )
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*key, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [*key, "_block"])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_block", "_carried")
    )


def byte_budget(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], text: str, rows: int = 200, size: int = 40960
) -> DataFrame:
    """Rows of each group that fit the row cap and the running size; the first misfit ends the group.

    The running sum sees at most ``rows`` rows per group.
    """
    head = top_per_group(df, group, order, rows)
    running = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("used", F.sum(F.length(text) + 1).over(running)).where(F.col("used") <= size)


def budget_report(df: DataFrame, group: Sequence[str], kept: DataFrame) -> DataFrame:
    """``group, total, kept, dropped`` for a budgeted frame."""
    total = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    held = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("kept"))
    return (
        total.join(held, list(group), "left")
        .withColumn("kept", F.coalesce("kept", F.lit(0)))
        .withColumn("dropped", F.col("total") - F.col("kept"))
    )


def shared_budget(
    rows: DataFrame, labels: Sequence[str], used: int = 0, max_rows: int = 200, max_bytes: int = 40 * 1024
) -> DataFrame:
    """One row ``texts, used``: the labelled blocks in order, sharing one size budget.

    ``rows`` has ``label, pos, line``. Each block takes rows until the row cap
    or the budget stops it and then states how many were left out. Only the
    first ``max_rows`` rows of a label reach the fold.
    """
    wanted = rows.where(F.col("label").isin(list(labels)))
    totals = wanted.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    heads = top_per_group(wanted, ["label"], [F.col("pos").asc()], max_rows)
    per_label = heads.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("head"))
    packed = (
        per_label.join(totals, "label")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("total", "head")))).alias("blocks"))
    )

    def block(state: Column, label: Column) -> Column:
        content = F.try_element_at(F.col("blocks"), label)
        head = F.coalesce(content["head"], F.expr("cast(array() as array<struct<rank: int, line: string>>)"))
        start = F.concat(F.lit("---"), label, F.lit("---\n"))
        filled = F.aggregate(
            head,
            F.struct(start.alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full")),
            lambda acc, r: F.when(
                acc["full"]
                | (state["used"] + F.length(acc["text"]) + F.length(r["line"]) + 1 > max_bytes),
                F.struct(acc["text"].alias("text"), acc["n"].alias("n"), F.lit(True).alias("full")),
            ).otherwise(
                F.struct(
                    F.concat(acc["text"], r["line"], F.lit("\n")).alias("text"),
                    (acc["n"] + 1).alias("n"),
                    F.lit(False).alias("full"),
                )
            ),
        )
        left_out = F.coalesce(content["total"], F.lit(0)) - filled["n"]
        text = F.when(
            left_out > 0,
            F.concat(filled["text"], F.lit("(... "), left_out.cast("string"), F.lit(" more truncated ...)\n")),
        ).otherwise(filled["text"])
        return F.struct(
            (state["used"] + F.length(text)).alias("used"), F.concat(state["texts"], F.array(text)).alias("texts")
        )

    folded = F.aggregate(
        F.array(*[F.lit(l) for l in labels]),
        F.struct(F.lit(used).alias("used"), F.array().cast("array<string>").alias("texts")),
        block,
    )
    return packed.select(folded.alias("f")).select("f.texts", "f.used")
