"""Whitening vectors on the leading components of their covariance.

Sums and products are exact integers, added up in the tasks. The covariance, as large as the vectors' dimension squared
whatever the number of rows, is split on the driver by QDWH spectral divide and conquer: the polar factor of the shifted
matrix, by QR-based dynamically weighted Halley steps, gives the projector on the eigenvectors above the shift; both
invariant subspaces are split again until single components are left. The rows are whitened by a broadcast of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lineage import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
EPS = float(np.finfo(float).eps)
# Entries may lie this far from their mean; squares then fit into a long.
FAR = 1 << 30
SUMS = "key long, low array<long>, high array<long>"


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: each eigenvalue becomes its sign."""
    m = len(a)
    one = np.eye(m)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    least = EPS
    for _ in range(30):
        square = least * least
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        alpha = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, one]))
        new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        least = min(1.0, least * (alpha + beta * square) / (1 + gamma * square))
        moved, x = np.linalg.norm(new - x), new
        if 1 - least < 10 * EPS and moved < np.sqrt(m) * EPS ** (1 / 3):
            break
    return x


def halves(a: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of two invariant subspaces of ``a``: that of the larger eigenvalues, and the rest.

    Shifts lie between the smallest and the largest diagonal entry, so there are eigenvalues on both sides. One that
    meets an eigenvalue leaves the projector's rank open; then the next is tried, and the best is taken.
    """
    m = len(a)
    diagonal = np.sort(np.diag(a))
    low, high = diagonal[0], diagonal[-1]
    spread = max(high - low, floor)
    draw = np.random.default_rng(m)
    shifts = [np.median(diagonal), diagonal.mean(), *(low + spread * draw.random(10))]
    mixed = draw.standard_normal((m, m))
    best = None
    for shift in shifts:
        projector = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
        rank = min(m - 1, max(1, round(np.trace(projector))))
        q, _ = np.linalg.qr(projector @ mixed)
        q, _ = np.linalg.qr(np.hstack([projector @ q[:, :rank], q[:, rank:]]))
        left = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank])
        if best is None or left < best[0]:
            best = left, q[:, :rank], q[:, rank:]
        if left <= floor:
            break
    return best[1], best[2]


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Each vector's largest entry is positive. Subspaces that hold none of the wanted are not split further.
    """
    floor = 20 * EPS * max(np.linalg.norm(v), np.finfo(float).tiny) * np.sqrt(len(v))
    waiting: list[np.ndarray] = [np.eye(len(v))]
    found: list[tuple[float, np.ndarray]] = []
    # The last of the waiting holds the largest eigenvalues left.
    while waiting and len(found) < wanted:
        basis = waiting.pop()
        own = basis.T @ v @ basis
        own = (own + own.T) / 2
        if len(own) == 1 or np.linalg.norm(own - np.diag(np.diag(own))) <= floor:
            found += [(own[i, i], basis[:, i]) for i in np.argsort(-np.diag(own), kind="stable")]
            continue
        above, below = halves(own, floor)
        waiting += [basis @ below, basis @ above]
    found = sorted(found, key=lambda x: -x[0])[:wanted]
    values = np.array([e for e, _ in found])
    vectors = np.array([x / np.linalg.norm(x) * np.sign(x[np.argmax(np.abs(x))]) for _, x in found]).T
    return values, vectors.reshape(len(v), len(found))


def exact(column: Column) -> Column:
    """Entries as longs; null for a null vector and one with null or non-finite entries."""
    c = column.cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(c, lambda x: F.floor(x * SCALE) + SHIFT))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def limbs(key: int, total: np.ndarray) -> tuple[int, list[int], list[int]]:
    """Sums cut into 32 low bits and the rest, so that many add up without leaving a long."""
    return key, (total & 0xFFFFFFFF).tolist(), (total >> 32).tolist()


def as_rows(rows: list[tuple[int, list[int], list[int]]]) -> pa.RecordBatch:
    key, low, high = zip(*rows, strict=True) if rows else ((), (), ())
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(low, longs), pa.array(high, longs)], names=["key", "low", "high"])


def added(parts: DataFrame) -> dict[int, list[int]]:
    """The sum of the arrays of each key, as whole numbers. Tasks add row by row; what leaves them is one array a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for key, *arrays in zip(*(batch.column(i) for i in range(3)), strict=True):
                new = [a.values.to_numpy(zero_copy_only=False) for a in arrays]
                old = held.get(key.as_py())
                held[key.as_py()] = [a + b for a, b in zip(old, new, strict=True)] if old else new
        yield as_rows([(key, low.tolist(), high.tolist()) for key, (low, high) in held.items()])

    out = parts.repartition("key").mapInArrow(run, SUMS).collect()
    return {r["key"]: [a + (b << 32) for a, b in zip(r["low"], r["high"], strict=True)] for r in out}


@dataclass
class Fit:
    """What the rows are whitened with: ``mean`` is near the exact mean ``sums / n``, ``rest`` is ``sums - n * mean``."""

    n: int
    dims: int
    mean: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> Fit | None:
    """Mean, covariance and its leading components over all ``x`` (arrays of longs) of the commonest length.

    Of equally common lengths the longest counts. Components whose eigenvalue is zero within rounding are left out.
    None if there are no vectors.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                x = matrix(column.filter(pa.array(sizes == size))) if size else np.zeros((int((sizes == 0).sum()), 0), np.int64)
                held[int(size)] = held.get(int(size), 0) + np.r_[len(x), x.sum(axis=0)]
        yield as_rows([limbs(size, total) for size, total in held.items()])

    totals = added(vectors.select("x").mapInArrow(sums, SUMS))
    dims = max((size for size in totals if size), key=lambda size: (totals[size][0], size), default=0)
    if not dims:
        return None
    n, total = totals[dims][0], totals[dims][1:]
    mean = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, mean, strict=True)]
    about = np.array(mean, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((dims, dims), np.int64)
        for batch in batches:
            y = matrix(batch.column(0)) - about
            far = int(np.abs(y).max(initial=1))
            if far > FAR:
                raise OverflowError(f"an entry lies {far / SCALE:.3g} from the mean, {FAR // SCALE} is the most")
            # Floating-point products and sums are exact below 2 ** 53.
            float_rows, long_rows = (1 << 53) // far**2, (1 << 61) // far**2
            step = max(1, float_rows or long_rows)
            for a in range(0, len(y), step):
                part = y[a : a + step]
                held += (part.T.astype(float) @ part).astype(np.int64) if float_rows else part.T @ part
                if np.abs(held).max() >= 1 << 61:
                    yield as_rows([limbs(i, held[i]) for i in range(dims)])
                    held[:] = 0
        yield as_rows([limbs(i, held[i]) for i in range(dims)])

    own = vectors.where(F.size("x") == dims)
    products_of = added(own.select("x").mapInArrow(products, SUMS))
    # A quotient of whole numbers is rounded once.
    covariance = np.array([[(n * products_of[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, basis = components(covariance, min(wanted, dims))
    trace = float(np.trace(covariance))
    sure = values > trace * dims * EPS
    return Fit(n, dims, mean, rest, values[sure], basis[:, sure], trace)


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or hold null or non-finite entries are left out, and those of another length than the
    commonest. ``deviation`` is an exact decimal. Repeated rows and null ids are vectors like others; other columns are
    not read. Components of no variance are left out, so equal vectors, a single one and an empty table give no rows.
    An entry over a million from its mean is an error. Memory is one batch of rows and a few matrices a task.
    """
    vectors = rows.select(F.col(vec_id).alias("vec_id"), exact(F.col(embedding)).alias("x")).where("x is not null")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    model = fit(vectors, wanted)
    if model is None or not len(model.values):
        names = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {names}")
    n, dims, k = model.n, model.dims, len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        about, left = np.array(model.mean, np.int64), np.array([r / model.n for r in model.rest])
        scaled = model.vectors / np.sqrt(model.values)
        for batch in batches:
            y = matrix(batch.column(1)) - about
            white = (y - left) @ scaled
            most = (model.n * int(np.abs(y).max(initial=0)) + max(map(abs, model.rest))) ** 2 * dims
            if most < 1 << 63:
                away = pa.array(((model.n * y - np.array(model.rest, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exactly = (model.n * y.astype(object) - np.array(model.rest, object)) ** 2
                away = pa.array([int(x) for x in exactly.sum(axis=1)], pa.decimal128(38, 0))
            offsets = pa.array(np.arange(0, white.size + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), away, pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["vec_id", "deviation", "w"])

    fitted = vectors.where(F.size("x") == dims)
    stored = materialize(fitted.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    at = lambda i: F.get("w", F.lit(i))
    sums = stored.agg(*[F.sum(at(i)).alias(f"s{i}") for i in range(k)], *[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in cells]).first()
    error = max(abs(sums[f"p{i}_{j}"] / n - sums[f"s{i}"] / n * (sums[f"s{j}"] / n) - (i == j)) for i, j in cells)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = stored.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
