"""Streaming queries: tables replayed as streams until all input is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.catalog.derived import FINDINGS, findings
from plumbline.catalog.findings import ERRORS, NDJSON, ndjson_lines
from plumbline.plans.lineage import scratch_path
from plumbline.streaming import intake


@query("stream_fingerprint", NDJSON)
def stream_fingerprint(spark, d):
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "fingerprints", "state"))
    ndjson_lines(spark, d).write.text(landing)
    stream = spark.readStream.schema("value string").text(landing)
    intake.stream_fingerprint(stream, out, state).awaitTermination()
    return spark.read.parquet(out).select("id", "fp", "error")


@query(
    "stream_intake",
    f"""WITH {FINDINGS}, {ERRORS}, bad AS (SELECT id, count(*) AS n FROM errs WHERE code <> 'taken' GROUP BY id)
    SELECT id, 'stored' AS side, fp, CAST(0 AS BIGINT) AS errors, CAST(1 AS BIGINT) AS rows FROM findings WHERE id NOT IN (SELECT id FROM bad)
    UNION ALL SELECT id, 'rejected', NULL, 1, 2 FROM findings WHERE id NOT IN (SELECT id FROM bad)
    UNION ALL SELECT id, 'rejected', NULL, n + (k = 1)::BIGINT, CASE WHEN k = 0 THEN 2 ELSE 1 END FROM bad, (SELECT unnest([0, 1]) AS k)""",
)
def stream_intake(spark, d):
    landing, stored, refused, state = (scratch_path(spark, n) for n in ("landing", "findings", "refused", "state"))
    f = findings(spark, d).drop("fp")
    # Every record arrives three times, twice in the first drop: repetitions are rejected, near and far.
    f.unionByName(f).write.mode("append").parquet(landing)
    schema = spark.read.parquet(landing).schema
    stream = lambda: intake.stream_intake(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(landing).withColumn("fp", F.lit(None).cast("string")), stored, refused, state)
    stream().awaitTermination()
    f.write.mode("append").parquet(landing)
    stream().awaitTermination()
    kept = spark.read.parquet(stored).select("id", F.lit("stored").alias("side"), "fp", F.lit(0).cast("bigint").alias("errors"))
    lost = spark.read.parquet(refused).select("id", F.lit("rejected").alias("side"), F.lit(None).cast("string").alias("fp"), F.size("errors").cast("bigint").alias("errors"))
    return kept.unionByName(lost).groupBy("id", "side", "fp", "errors").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_churn",
    """WITH w AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events), p AS (SELECT unnest([0, 1, 2]) AS k),
    x AS (SELECT user_id AS item, event_type, (s // 86400 - k) * 86400 AS start FROM w, p), m AS (SELECT max(epoch_us(ts)) / 1000000.0 - 3600 AS mark FROM events)
    SELECT item, CAST(start AS BIGINT) AS start, count(*) AS commits, count(DISTINCT event_type) AS actors FROM x, m WHERE start + 3 * 86400 <= mark GROUP BY item, start""",
)
def stream_churn(spark, d):
    out, state = scratch_path(spark, "churn"), scratch_path(spark, "state")
    # A pattern, because a stream source takes folders or patterns, not one file.
    source = f"{d}/[e]vents.parquet"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(source)
    changes = events.select(F.col("user_id").alias("item"), F.col("event_type").alias("actor"), F.col("ts").cast("timestamp").alias("ts"))
    intake.stream_churn(changes, out, state, window="3 days", slide="1 day", late="1 hour").awaitTermination()
    return spark.read.parquet(out).select("item", F.unix_seconds("window_start").alias("start"), "commits", "actors")


@query(
    "batch_churn_windows",
    """WITH w AS (SELECT user_id AS item, event_type, epoch_us(ts) // 1000000 AS s FROM events), p AS (SELECT unnest([0, 1, 2]) AS k), x AS (SELECT item, event_type, (s // 86400 - k) * 86400 AS start FROM w, p)
    SELECT item, CAST(start AS BIGINT) AS start, count(*) AS commits, count(DISTINCT event_type) AS actors FROM x GROUP BY item, start""",
)
def batch_churn_windows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("actor"), F.col("ts").cast("timestamp").alias("ts"))
    return intake.churn_windows(e, window="3 days", slide="1 day", late="1 hour").select(
        "item", F.unix_seconds("window_start").alias("start"), "commits", "actors"
    )
