"""Layout of scans before heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Number of pieces for tables that a small installation stores as one file; unset on a cluster.
PIECES = "spark.plumbline.pieces"
# Rows of a piece that a task sorts or counts by key, and as many pieces as Spark writes without sorting them in memory.
PIECE_ROWS = 200_000
MOST_PIECES = 200


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a table by its keys if the session asks for it.

    A table of one small file would run its text expressions on one core. The
    session of a single machine says into how many pieces to deal such tables;
    without the setting they are read as they lie and no text is shuffled.
    """
    pieces = df.sparkSession.conf.get(PIECES, None)
    return df.repartition(int(pieces), *keys) if pieces else df


def pieces(rows: int) -> int:
    """Into how many pieces to deal ``rows``. Spark itself goes by compressed bytes, so that narrow sorted keys come millions to a task."""
    return min(rows // PIECE_ROWS + 1, MOST_PIECES)
