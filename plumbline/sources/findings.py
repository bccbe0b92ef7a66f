"""Findings records: NDJSON intake and the append path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.hashing import fingerprint, fingerprint_error

RECORD_SCHEMA = "id string, lens string, quoted string, quotedLines string, symbol string, _corrupt_record string"


def quoted_array(raw: Column) -> Column:
    """A JSON string or array of strings to an array; NULL elements mark non-strings."""
    return (
        F.when(raw.isNull(), F.lit(None).cast("array<string>"))
        .when(raw.rlike(r"\A\s*\["), F.from_json(raw, "array<string>"))
        .otherwise(F.array(raw))
    )


def fingerprint_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """One output row per non-blank input line: ``id, fp, lens, symbol, error``.

    Works on batch and streaming frames alike; nothing is dropped, a bad line
    has a NULL ``fp`` and the reason in ``error``.
    """
    parsed = lines.where(F.col(value).rlike(r"\S")).withColumn(
        "r", F.from_json(value, RECORD_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    quoted = F.coalesce(quoted_array(F.col("r.quoted")), quoted_array(F.col("r.quotedLines")))
    bad_json = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.col(value).rlike(r"\A\s*\{")
    error = F.when(bad_json, F.lit("not_json")).otherwise(fingerprint_error(F.col("r.lens"), quoted))
    return parsed.withColumn("error", error).select(
        F.when(~bad_json, F.col("r.id")).alias("id"),
        F.when(F.col("error").isNull(), fingerprint(F.col("r.lens"), quoted, F.col("r.symbol"))).alias("fp"),
        F.when(F.col("error").isNull(), F.col("r.lens")).alias("lens"),
        F.when(F.col("error").isNull(), F.col("r.symbol")).alias("symbol"),
        "error",
    )


def read_findings_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return fingerprint_records(spark.read.text(path))


def read_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Findings from NDJSON lines, with ``unknown_keys``: the keys a record has beyond the schema. Bad lines are rows of nulls."""
    from plumbline.operators.findings import FINDING_SCHEMA

    schema = StructType.fromDDL(FINDING_SCHEMA)
    known = F.array(*[F.lit(f.name) for f in schema])
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    # Parsed once a row: exploding one element keeps the parser from being repeated for every field.
    record = F.struct(F.from_json(value, schema).alias("r"), F.array_except(keys, known).alias("unknown_keys"))
    parsed = lines.where(F.col(value).rlike(r"\S")).select(F.explode(F.array(record)).alias("x"))
    return parsed.select("x.r.*", "x.unknown_keys")


def append_findings(batch: DataFrame, table_path: str, rejected_path: str) -> tuple[int, int]:
    """Validate, fingerprint and append a batch; all or nothing.

    A column ``unknown_keys`` (see ``read_records``) makes unknown keys errors.

    Any invalid record, or an id already in the table, rejects the whole batch,
    which then goes to ``rejected_path`` with its errors. Returns the numbers of
    appended and rejected records.
    """
    from plumbline.operators.findings import validate_records
    from plumbline.plans.lineage import materialize

    spark = batch.sparkSession
    unknown = "unknown_keys" if "unknown_keys" in batch.columns else None
    checked = validate_records(batch, known_ids=existing_ids(spark, table_path), unknown_keys=unknown).drop("unknown_keys")
    checked = checked.withColumn("quoted", F.flatten(F.transform("evidence", lambda e: e["quoted"])))
    checked = materialize(checked, "intake")
    total, bad = checked.agg(
        F.count(F.lit(1)), F.coalesce(F.sum((F.size("errors") > 0).cast("bigint")), F.lit(0))
    ).first()
    if bad:
        checked.drop("quoted").write.mode("append").parquet(rejected_path)
        return 0, total
    accepted = checked.withColumn("fp", fingerprint(F.col("lens"), F.col("quoted"), F.col("symbol")))
    accepted.drop("errors", "quoted").write.mode("append").parquet(table_path)
    return total, 0


def existing_ids(spark: SparkSession, table_path: str) -> DataFrame | None:
    """Ids of a findings table, or None while it does not exist yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return None
    return spark.read.parquet(table_path).select("id")
