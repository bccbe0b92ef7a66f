"""Shared by the operators and queries of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts pass between the JVM and Python ``rows`` at a time, so the buffers on both sides stay a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def release(spark: SparkSession) -> None:
    """Gives freed memory of both sides of the driver back: tables sent around by plans that are done stay until then."""
    trim()
    spark._jvm.System.gc()


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, then ``trim``: a worker that waits for its next task holds little."""

    @wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        trim()

    return tidied


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


SLOTS = 1 << 23


def own_id(key: Column, text: Column) -> Column:
    """The id as a long; for a null id a number made of the text, above all usual ids."""
    made = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    return F.coalesce(key.cast("long"), made)


def prefilter(df: DataFrame, on: Column, wanted: DataFrame, by: Column, flag: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` may be among the values ``by`` of ``wanted``: none is lost, a few others stay.

    With ``flag`` all rows stay, and a column of that name says which these are.

    Keeps rows that can't match out of the shuffle of the join that follows. What is sent around is a bitmap of
    ``SLOTS`` bits, whatever the size of ``wanted``; when that fills up, fewer rows are kept out. Rows don't leave the
    JVM for it.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)) + 1
    found = (
        wanted.select(slot(by).alias("s"))
        .groupBy(F.bitmap_bucket_number("s").alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        .collect()
    )
    names = df.columns
    if not found:
        return df.withColumn(flag, F.lit(False)) if flag else df.where("false")
    pages = [(row["page"], np.frombuffer(bytes(row["bits"]), "<i8").tolist()) for row in found]
    # At most SLOTS / 32768 rows of 512 numbers: 1 MB.
    bits = F.broadcast(df.sparkSession.createDataFrame(pages, "_pf_page long, _pf_bits array<long>").coalesce(1))
    placed = df.withColumn("_pf_slot", slot(on))
    at = F.bitmap_bit_position("_pf_slot").cast("int")
    held = F.coalesce(F.getbit(F.get("_pf_bits", F.floor(at / 64).cast("int")), at % 64) == 1, F.lit(False))
    met = placed.join(bits, F.bitmap_bucket_number("_pf_slot") == F.col("_pf_page"), "left")
    if flag:
        return met.select(*names, held.alias(flag))
    return met.where(held).select(*names)
