"""Near duplicates among vectors: sign hashing by random hyperplanes, exact cosines, connected components.

In each table a vector's bucket is the signs of its products with the table's hyperplanes. Vectors of a bucket are
compared exactly; a bucket larger than a block is cut into blocks, and pairs of blocks are compared in tasks of their
own, so no task holds a bucket. A pair counts in the first table in which both share a bucket. What leaves a task is a
count for each vector and links enough to connect its groups, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import connected_components
from plumbline.plans.lineage import materialize

MIN_COSINE = 0.9
RECALL = 0.995
# Vectors that a bucket holds on average if they point anywhere; bits grow with the logarithm of their number.
PER_BUCKET = 64
BLOCK = 512
SEED = 20240229


def layout(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL, per_bucket: int = PER_BUCKET) -> tuple[int, int]:
    """Bits and tables that find a pair at the threshold with probability ``recall``; closer pairs more often."""
    bits = max(4, min(56, math.ceil(math.log2(max(n, 1) / per_bucket)))) if n > per_bucket * 16 else 4
    hit = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def codes(unit: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Bucket numbers ``[vectors, tables]``. Hyperplanes depend on the dimension and the seed only."""
    planes = np.random.default_rng([seed, unit.shape[1], bits, tables]).standard_normal((unit.shape[1], tables * bits))
    signs = (unit @ planes >= 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def units(vectors: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of tiny and huge values exact enough.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, embedding: str) -> DataFrame:
    """Adds ``_ok``: not null, not empty, not all zero, no null and no non-finite component."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ok = e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0)
    return vectors.withColumn("_ok", F.coalesce(ok, F.lit(False)))


def compare(left: np.ndarray, right: np.ndarray, min_cosine: float) -> np.ndarray:
    """Which pairs of unit vectors reach the cosine. Products within rounding of it are summed exactly."""
    cosine = left @ right.T
    linked = cosine >= min_cosine
    for i, j in np.argwhere(np.abs(cosine - min_cosine) < 1e-13):
        linked[i, j] = math.fsum((left[i] * right[j]).tolist()) >= min_cosine
    return linked


def spanning(linked: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``linked`` connects among ``nodes``, at most one fewer than there are nodes."""
    parent = np.arange(len(nodes))
    out = []
    for i in range(len(nodes)):
        reached = np.flatnonzero(linked[i])
        if not len(reached):
            continue
        roots = np.unique(parent[np.append(reached, i)])
        if len(roots) > 1:
            for r in roots[1:]:
                parent[parent == r] = roots[0]
                out.append((int(nodes[roots[0]]), int(nodes[r])))
    return out


def link(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", min_cosine: float = MIN_COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Equal vectors are folded first and count as linked with each other. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different dimension. Repeated rows and null keys
    are allowed: each row is a vector of its own, and ``kept`` marks those whose key is their component's smallest. An
    empty table gives no rows; other columns are not read.
    """
    rows = usable(vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v")), "v")
    keyed = rows.withColumn("h", F.when(F.col("_ok"), F.xxhash64("v")))
    members = materialize(keyed.select("key", "h"), "members")
    # Equal vectors; a 64-bit hash stands for the components.
    folded = keyed.where("_ok").groupBy("h").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    folded = materialize(folded, "vectors")
    n = folded.count()
    bits, tables = layout(n, min_cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) for x in batch.column(1).to_pylist()])
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                v = np.array(batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                code = codes(units(v), bits, tables)
                at = np.repeat(own, tables)
                table = np.tile(np.arange(tables), len(own))
                # The dimension is part of the bucket.
                bucket = code.ravel() * 65_537 + dim
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(table.astype(np.int32)), pa.array(bucket)], names=["h", "t", "bucket"]
                )

    placed = materialize(folded.select("h", "v").mapInArrow(hashed, "h long, t int, bucket long"), "buckets")
    sizes = placed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = F.ceil(F.col("k") / block).cast("int")
    dealt = placed.join(sizes.select("t", "bucket", blocks.alias("blocks")), ["t", "bucket"])
    mine = F.pmod(F.xxhash64("h", "t"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    # Small buckets share tasks: a group is a table's buckets with equal ending, a cell of a large bucket is its own.
    cells = dealt.join(folded.select("h", "copies", "v"), "h")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        t, i, j = int(frame["t"].iloc[0]), int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        h = frame["h"].to_numpy()
        copies = frame["copies"].to_numpy()
        unit = units(np.stack(frame["v"].to_numpy()).astype(np.float64))
        earlier = codes(unit, bits, tables)[:, :t]
        a = np.flatnonzero(frame["mine"].to_numpy() == i)
        b = a if i == j else np.flatnonzero(frame["mine"].to_numpy() == j)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        linked = compare(unit[a], unit[b], min_cosine)
        if i == j:
            np.fill_diagonal(linked, False)
        x, y = np.nonzero(linked)
        new = np.ones(len(x), bool)
        for s in range(0, len(x), 100_000):
            new[s : s + 100_000] = ~(earlier[a[x[s : s + 100_000]]] == earlier[b[y[s : s + 100_000]]]).any(axis=1)
        x, y = x[new], y[new]
        count = np.bincount(a[x], copies[b[y]], minlength=len(h))
        if i != j:
            count += np.bincount(b[y], copies[a[x]], minlength=len(h))
        fresh = np.zeros((len(h), len(h)), bool) if len(x) else None
        edges = []
        if fresh is not None:
            fresh[a[x], b[y]] = True
            edges = spanning(fresh, h)
        some = np.flatnonzero(count)
        return pd.DataFrame(
            {
                "a": [*h[some].tolist(), *(e[0] for e in edges)],
                "b": pd.array([None] * len(some) + [e[1] for e in edges], "Int64"),
                "n": [*count[some].astype(np.int64).tolist(), *[0] * len(edges)],
            }
        )

    found = materialize(cells.groupBy("t", "bucket", "i", "j").applyInPandas(cell, "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n"))
    component = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("h"), "component")
    whole = folded.select("h", "key", "copies").join(component, "h", "left").withColumn("c", F.coalesce("component", "h"))
    least = whole.groupBy("c").agg(F.min("key").alias("component_id"))
    known = whole.join(counts, "h", "left").join(least, "c")
    known = known.select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    own = members.join(known, "h", "left").select(
        F.col("key").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
    )
    return own.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
