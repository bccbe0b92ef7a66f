"""Change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions.text import trim_ws

# Fixed value: line that opens a basket in a log export.
COMMIT_DELIM = "@@@COMMIT@@@"


def read_changes(spark: SparkSession, path: str, delimiter: str = COMMIT_DELIM, source_only: bool = True) -> DataFrame:
    """Log text to distinct ``(basket_id, item)`` rows.

    The delimiter is the record separator of the scan, so a log of any size is
    split between tasks and every record already is one basket. The basket id
    is the record's position (file, byte order); lines before the first
    delimiter belong to no basket.
    """
    raw = spark.read.option("lineSep", delimiter).text(path)
    opened = (
        raw.withColumn("file", F.col("_metadata.file_path"))
        .withColumn("start", F.col("_metadata.file_block_start"))
        .withColumn("basket_id", F.monotonically_increasing_id())
    )
    first_of_file = opened.groupBy("file").agg(F.min("basket_id").alias("first_id"))
    # The text before the first delimiter is the first record of each file.
    baskets = opened.join(first_of_file, "file").where(F.col("basket_id") > F.col("first_id"))
    items = (
        baskets.select("basket_id", F.explode(F.split("value", "\n")).alias("line"))
        .select("basket_id", paths.to_posix(trim_ws(F.col("line"))).alias("item"))
        .where(F.length("item") > 0)
    )
    if source_only:
        items = items.where(paths.is_source(F.col("item")))
    return items.distinct()
