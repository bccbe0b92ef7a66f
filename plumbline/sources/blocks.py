"""Sectioned text reports: ``key: value`` headers, then ``---label---`` blocks of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.windows import shared_budget

LABEL_RE = r"---(.+)---\s*"


def parse_blocks(text: Column) -> Column:
    """``array<struct<label, rows>>``; the header part has a NULL label.

    The text is cut in front of each label line, so no running state is needed
    and an empty block is still present (with no rows).
    """
    chunks = F.split(text, r"(?md)(?=^---.+---[ \t\r]*$)")
    return F.transform(
        F.filter(chunks, lambda s: F.length(s) > 0),
        lambda s: F.struct(
            F.when(
                s.rlike(r"\A---[^\n]+---[ \t\r]*(?:\n|\z)"), F.regexp_extract(s, r"\A---([^\n]+)---", 1)
            ).alias("label"),
            F.when(s.rlike(r"\A---[^\n]+---[ \t\r]*(?:\n|\z)"), F.regexp_replace(s, r"\A[^\n]*\n?", ""))
            .otherwise(s)
            .alias("body"),
        ),
    )


def blocks_of(reports: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``(source, label, row_no, line)``; an empty block gives one row with NULL ``row_no``."""
    cut = reports.select(F.col(source).alias("source"), F.explode(parse_blocks(F.col(text))).alias("b"))
    return (
        cut.where(F.col("b.label").isNotNull())
        .select(
            "source",
            "b.label",
            F.posexplode_outer(
                F.filter(F.split("b.body", r"\r?\n"), lambda l: l.rlike(r"\S"))
            ).alias("pos", "line"),
        )
        .select("source", "label", (F.col("pos") + 1).alias("row_no"), "line")
    )


def headers_of(reports: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``(source, key, value)`` from the part before the first block."""
    cut = reports.select(F.col(source).alias("source"), F.explode(parse_blocks(F.col(text))).alias("b"))
    header = cut.where(F.col("b.label").isNull()).select(
        "source", F.explode(F.split("b.body", r"\r?\n")).alias("line")
    )
    return header.where(F.col("line").rlike(r"^[A-Za-z0-9_-]+\s*:\s*\S")).select(
        "source",
        F.regexp_extract("line", r"^([A-Za-z0-9_-]+)\s*:", 1).alias("key"),
        F.rtrim(F.regexp_extract("line", r"^[A-Za-z0-9_-]+\s*:\s*(.+?)\s*$", 1)).alias("value"),
    )


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and headers of every report under ``path`` (each report is at most a few dozen KiB)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")
    )
    return blocks_of(raw), headers_of(raw)


def write_blocks(
    rows: DataFrame,
    path: str,
    labels: Sequence[str],
    headers: Sequence[str] = (),
    max_rows: int = 200,
    max_bytes: int = 40 * 1024,
) -> None:
    """Write ``(label, pos, line)`` rows as one capped report.

    The row cap and the byte budget are the report format's own limits; blocks
    appear in the order of ``labels`` and share the budget.
    """
    body = shared_budget(rows, labels, used=len("\n".join(headers)) + 1, max_rows=max_rows, max_bytes=max_bytes)
    head = "\n".join(headers)
    text = F.array_join("texts", "")
    whole = F.concat(F.lit(head + "\n"), text) if headers else text
    # One row of at most ``max_bytes``; the writer adds the final line break itself.
    body.select(F.regexp_replace(whole, r"\n\z", "").alias("value")).write.mode("overwrite").text(path)
