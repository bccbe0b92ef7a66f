"""Table and corpus scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import paths

# Folders that never hold citable documents.
SKIP_DIRS = ["node_modules", "coverage", "reports", "playwright-report", "dist", "build", "out", ".stryker-tmp"]
KEPT_DOT_DIRS = [".github"]


def load_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: StructType | str | None = None
) -> DataFrame:
    """Scan one table. CSV and JSON need a schema so no inference pass reads the data."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "parquet":
        return reader.parquet(f"{folder}/{name}.parquet")
    if schema is None:
        raise ValueError(f"{fmt} scans need an explicit schema")
    if fmt == "csv":
        return reader.option("header", True).csv(f"{folder}/{name}.csv")
    if fmt == "json":
        return reader.json(f"{folder}/{name}.json")
    raise ValueError(f"unsupported format: {fmt}")


def kept_path(path, skip_dirs: Sequence[str] = SKIP_DIRS):
    """Predicate: no segment is a skipped folder, nor a dot entry outside the allow-list."""
    segments = F.split(path, "/")
    return ~F.exists(
        segments,
        lambda s: s.isin(list(skip_dirs)) | (s.startswith(".") & ~s.isin(KEPT_DOT_DIRS)),
    )


def hidden_roots(spark: SparkSession, root: str) -> list[str]:
    """Patterns below ``root`` for folders a scan leaves out by default (a leading ``_``, kept dot folders).

    One pattern per depth, down to the deepest folder. Only patterns that match
    something are returned; names are listed by the file system, no content is read.
    """
    names = "{_*," + ",".join(KEPT_DOT_DIRS) + "}"
    conf = spark._jsc.hadoopConfiguration()

    def matches(pattern: str) -> list:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        return list(path.getFileSystem(conf).globStatus(path) or [])

    found, above = [], root.rstrip("/")
    while True:
        if matches(f"{above}/{names}"):
            found.append(f"{above}/{names}")
        above += "/*"
        if not any(s.isDirectory() for s in matches(above)):
            return found


def scan_corpus(spark: SparkSession, root: str, skip_dirs: Sequence[str] = SKIP_DIRS) -> DataFrame:
    """One row per document under ``root``: ``path`` (relative), ``text``.

    The path filter is evaluated on the file name, so no text of a skipped
    folder enters the plan above the scan. Folders with a leading underscore and
    kept dot folders are found at any depth; single files with a leading
    underscore are invisible to Spark's file listing.
    """
    raw = spark.read.text([root, *hidden_roots(spark, root)], wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")
    )
    decoded = F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B")))
    marker = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.substring_index(decoded, marker + "/", -1)
    # The writers' own marker files are no documents.
    kept = kept_path(F.col("path"), skip_dirs) & ~F.col("path").rlike(r"(^|/)_(SUCCESS|spark_metadata)(/|$)")
    return raw.withColumn("path", paths.to_posix(relative)).where(kept).select("path", "text")
