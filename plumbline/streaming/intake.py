"""Streaming intake: fingerprints, validated appends, windowed churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.hashing import fingerprint
from plumbline.operators.findings import record_errors
from plumbline.plans.lineage import materialize
from plumbline.sources.findings import fingerprint_records


def stream_fingerprint(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """NDJSON lines in, exactly one row out per non-blank line. Stateless, so it needs no watermark."""
    return (
        fingerprint_records(lines)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


ID_BUCKETS = 256


def id_bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(ID_BUCKETS)).cast("int")


def stored_ids(spark: SparkSession, ids: str, batch_id: int, buckets: list[int]) -> DataFrame | None:
    """Ids accepted by other micro-batches, read from the buckets that this one touches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ids)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    schema = "id string, batch_id bigint, bucket int"
    known = spark.read.schema(schema).parquet(ids)
    return known.where(F.col("bucket").isin(buckets) & (F.col("batch_id") != batch_id)).select("id").distinct()


def stream_intake(findings: DataFrame, table: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Validate, fingerprint and append a findings stream; ids are never reused.

    The first valid arrival of an id is stored; every repetition, in the same micro-batch or any time later, is rejected
    with that reason. Accepted rows, their ids and rejected rows are each written to a folder of the micro-batch, which a
    replayed batch overwrites, and ids are compared with other batches' only: a replay gives the same tables. Ids are
    kept by hash bucket, so a small batch reads the buckets of its own ids. Unknown keys of the records, if the column
    ``unknown_keys`` lists them, are errors.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A micro-batch can be read again from its source, so its records needn't be stored before they are ranked.
        rows = batch.withColumn("_bucket", id_bucket(F.col("id")))
        buckets = [r[0] for r in rows.select("_bucket").distinct().collect() if r[0] is not None]
        known = stored_ids(spark, ids, batch_id, buckets)
        names = [c for c in rows.columns if c not in ("_bucket", "unknown_keys")]
        unknown = F.col("unknown_keys") if "unknown_keys" in rows.columns else None
        own = rows.withColumn("_errors", record_errors(F.lit(False), unknown=unknown))
        # Of equal ids the first valid row counts, in the order of its content; it alone can be stored.
        order = Window.partitionBy("id").orderBy(F.size("_errors") > 0, F.xxhash64(*names))
        ranked = own.withColumn("_nth", F.row_number().over(order)).drop("_errors")
        duplicate = F.col("id").isNotNull() & (F.col("_nth") > 1)
        if known is not None:
            ranked = ranked.join(known.withColumn("_known", F.lit(True)), "id", "left")
            duplicate = duplicate | F.coalesce("_known", F.lit(False))
        checked = materialize(ranked.withColumn("errors", record_errors(duplicate, unknown=unknown)), "checked", compression="zstd")
        quoted = F.flatten(F.transform("evidence", lambda e: e["quoted"]))
        good = checked.where(F.size("errors") == 0)
        stored = good.select(*names).withColumn("fp", fingerprint(F.col("lens"), quoted, F.col("symbol")))
        number = F.lit(batch_id).cast("bigint")
        place = lambda root: f"{root}/batch_id={batch_id}"
        good.select("id", F.col("_bucket").alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place(ids))
        stored.write.mode("overwrite").parquet(place(table), compression="zstd")
        bad = checked.where(F.size("errors") > 0).select(*names, "errors")
        bad.withColumn("rejected_in", number).write.mode("overwrite").parquet(place(rejected), compression="zstd")

    ids = f"{table.rstrip('/')}-ids"
    return (
        findings.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
    )


def churn_windows(
    changes: DataFrame, item: str = "item", actor: str = "actor", ts: str = "ts", window: str = "180 days", slide: str = "30 days", late: str = "1 day"
) -> DataFrame:
    """``window_start, window_end, item, commits, actors`` over sliding windows.

    Changes are counted per actor first and those counts per item, so the state
    holds one row per actor and the actors are exact. Rows later than the
    watermark are dropped by the stream; that rule is this library's, the batch
    operator has none.
    """
    by_actor = (
        changes.withWatermark(ts, late)
        .groupBy(F.window(ts, window, slide).alias("w"), F.col(item), F.col(actor).alias("actor"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        by_actor.groupBy("w", item)
        .agg(F.sum("n").alias("commits"), F.count("actor").alias("actors"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), item, "commits", "actors")
    )


def stream_churn(changes: DataFrame, out: str, checkpoint: str, **windows: str) -> StreamingQuery:
    return (
        churn_windows(changes, **windows)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
