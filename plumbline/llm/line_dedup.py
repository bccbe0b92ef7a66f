"""Dropping lines that many documents share.

Lines are normalised and hashed, documents counted per hash, lines of hashes over the threshold dropped wherever they
stand but in the document with the largest id, and what is left is put together again by position. The texts meet the
positions of their dropped lines once; only hashes, ids and positions take part in the other shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lineage import materialize

DOCUMENTS = 3
CHARS = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# White space at the beginning and at the end of lines; a run is tried once, from its first character.
BLANK = r"[ \t\x0b\f\r]"
EDGES = rf"(?:^|(?<=\n)){BLANK}++|(?<!{BLANK}){BLANK}++(?=\n|\z)"


def line_keys(text: Column) -> Column:
    """The text's lines without white space at both ends, A-Z in lower case."""
    # Of an ASCII text lower() does the same, several times as fast.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(F.regexp_replace(low, EDGES, ""), "\n", -1)


def line_hashes(text: Column, chars: int) -> Column:
    """For each line the hash of its key, null if the key is shorter than ``chars``."""
    return F.transform(line_keys(text), lambda key: F.when(F.length(key) >= chars, F.md5(key)))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """One row per document: ``doc_id, text`` (what stays), ``n_lines`` (before dropping), ``n_dropped``.

    A null or empty text is one empty line. Every row is a document: rows that repeat an id or repeat whole count as
    several. A key of at least ``chars`` code points found in at least ``documents`` rows loses all its lines but those
    of the rows with the largest id that holds it (all of them if several rows have that id); null ids are smaller than
    all others, and if only null ids hold a key, its lines stay. A document of dropped lines only has an empty text. An
    empty table gives no rows; other columns are not read. Keys are compared by 128-bit MD5.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Counted and then looked up, so hashed once.
    hashed = materialize(texts.select("doc_id", F.xxhash64("text").alias("own"), line_hashes(F.col("text"), chars).alias("keys")), "line-hashes")

    held = hashed.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    shared = held.groupBy(F.unhex("key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    shared = shared.where((F.col("n") >= documents) & F.col("keeper").isNotNull()).select("key", "keeper")
    # Stored, so that the join can split a line that a third of the rows hold.
    shared = materialize(shared, "shared-lines")

    placed = hashed.select("doc_id", "own", F.posexplode("keys").alias("at", "key")).where("key is not null")
    met = placed.withColumn("key", F.unhex("key")).join(shared, "key")
    lost = met.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    # Rows that repeat whole share their positions.
    lost = lost.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).agg(F.collect_set("at").alias("lost"))

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_own"))
    found = texts.join(lost, same, "left").select("doc_id", F.split("text", "\n", -1).alias("lines"), "lost")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(every, "lost"), lambda at: F.get("lines", at))
    )
    return found.select(
        "doc_id", F.array_join(stay, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
