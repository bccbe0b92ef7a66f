"""Hot keys.

One key may own a third of all rows. Aggregations are safe (map-side combine),
joins on such a key are not. ``salted_join`` spreads the rows of the heaviest
keys over several tasks and replicates only the matching rows of the other side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A list of the heaviest keys never exceeds this many rows, whatever the data
# size, so broadcasting it is safe. With the top K keys set apart no remaining
# key can hold more than 1/K of the rows.
HEAVY_KEYS = 1000


def heavy_keys(df: DataFrame, on: Sequence[str], min_rows: int, k: int = HEAVY_KEYS) -> DataFrame:
    """The at most ``k`` most frequent keys that occur more than ``min_rows`` times."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > min_rows).orderBy(F.col("_rows").desc(), *on).limit(k).select(*on)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[Column] | None = None,
    buckets: int = 32,
    min_rows: int = 100_000,
) -> DataFrame:
    """Join where ``left`` may be skewed on ``on`` and ``right`` holds few rows per key.

    Rows of a heavy key get a salt derived from ``spread_by`` (a pure function
    of the row, so a retried task places it in the same bucket); the right rows
    of that key are copied into each bucket. Supports inner, left, left_semi
    and left_anti.
    """
    on = list(on)
    spread = spread_by or [F.col(c) for c in left.columns]
    hot = F.broadcast(heavy_keys(left, on, min_rows).withColumn("_hot", F.lit(True)))
    salted = left.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int")).otherwise(F.lit(0))
    )
    copies = right.join(hot, on, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))),
    )
    joined = salted.drop("_hot").join(copies.drop("_hot"), [*on, "_salt"], how)
    return joined.drop("_salt")
