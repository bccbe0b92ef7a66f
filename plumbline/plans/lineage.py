"""Cutting lineage in iterative plans.

Each round of a graph loop is written as a Parquet table under the folder the
cluster names in ``spark.checkpoint.dir`` and read back. Compared with
``DataFrame.checkpoint`` this runs the plan once, keeps the data columnar, and
gives the optimizer real sizes for the next round's join choice. A lost
executor costs only the running stage: finished rounds live in shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Tables stored since `passing` was entered, if it was.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(stored: list[str]) -> Iterator[None]:
    """Notes in ``stored`` where intermediate tables are put, for ``remove`` once nothing reads them any more."""
    token = _passing.set(stored)
    try:
        yield
    finally:
        _passing.reset(token)


def remove(spark: SparkSession, stored: list[str]) -> None:
    """Deletes the intermediate tables noted by ``passing``, through the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while stored:
        path = jvm.org.apache.hadoop.fs.Path(stored.pop())
        path.getFileSystem(conf).delete(path, True)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``, else its checkpoint folder.

    It has to be shared by the driver and all executors, so none is made up here.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/plumbline/{app}/{name}-{uuid.uuid4().hex}"
    stored = _passing.get()
    if stored is not None:
        stored.append(path)
    return path


def materialize(df: DataFrame, name: str = "step", compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored table; ``compression`` suits wide texts."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


class Accumulator:
    """Rows gathered over the rounds of a loop.

    Each round's rows are written once, next to the earlier ones, instead of
    rewriting everything found so far. ``FAN_IN`` pieces of one level are merged
    into one of the next, so a row is rewritten logarithmically often and the
    number of folders read stays small.
    """

    FAN_IN = 16

    def __init__(self, first: DataFrame, name: str) -> None:
        self._spark = first.sparkSession
        self._schema = first.schema
        self._name = name
        self._levels: list[list[str]] = []
        self.add(first)

    def _read(self, paths: list[str]) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*paths)

    def _keep(self, path: str, level: int) -> None:
        if level == len(self._levels):
            self._levels.append([])
        self._levels[level].append(path)
        if len(self._levels[level]) == self.FAN_IN:
            merged = scratch_path(self._spark, self._name)
            self._read(self._levels[level]).write.mode("errorifexists").parquet(merged)
            self._levels[level] = []
            self._keep(merged, level + 1)

    def add(self, rows: DataFrame) -> DataFrame:
        """Store a round's rows and return just them."""
        path = scratch_path(self._spark, self._name)
        rows.select(*self._schema.fieldNames()).write.mode("errorifexists").parquet(path)
        self._keep(path, 0)
        return self._read([path])

    def all(self) -> DataFrame:
        return self._read([p for level in self._levels for p in level])
