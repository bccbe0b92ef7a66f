"""Packing documents into fixed windows, online and in bounded space.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its rest goes to the open
window that it fills best. When all are open and none has room, the fullest is closed with the beginning of the rest and
emitted. The windows left open at the end of the partitions are merged in groups of partitions, largest pieces first,
until one group is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lineage import materialize

WINDOW = 1024
OPEN = 16
END = 0
TOKENIZER = "byte_bpe_50k.json"
FAN_IN = 64
# A merged window this full is closed at once.
CLOSED = 0.98

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STATE = PIECE + ", part long, open boolean"
MERGED = 1 << 61


def encoder(name: str = TOKENIZER):
    """Ids of a text by a public byte-level vocabulary, as an array.

    ``*.json`` names a tokenizer file whose ranks also exist as ``*.tiktoken``; both give the same ids (see the tests),
    the second several times as fast. Strings of the file's special tokens have their ids.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {}
    if name.endswith(".json"):
        with open(public_tokenizers.path(name), "rb") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    coding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coding.encode_to_numpy(text, allowed_special="all")


def best_fit(held: dict[int, int], length: int, window: int) -> int | None:
    """The open window with the least room that still takes ``length``; the oldest of equals."""
    fits = [(used, -k) for k, used in held.items() if used + length <= window]
    return -max(fits)[1] if fits else None


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    window: int = WINDOW,
    most_open: int = OPEN,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and the end id 0; a null or empty text is the end id alone. Sequences hold ``window`` ids at
    most, without gaps. Every id of every row lies in exactly one piece. Repeated rows are packed as separate
    documents, null ids too; an empty table gives no rows; other columns are not read. Memory is one batch of texts
    and ``most_open`` windows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        following = part << 40
        held: dict[int, int] = {}
        waiting: dict[int, list[tuple]] = {}
        done: list[tuple] = []

        def rows(pieces: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns]
            extra = [pa.array([part] * len(pieces), pa.int64()), pa.array([is_open] * len(pieces), pa.bool_())]
            return pa.RecordBatch.from_arrays([*arrays, *extra], names=[x.split()[0] for x in STATE.split(", ")])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                n, at = len(ids), 0
                while at < n:
                    length = min(n - at, window)
                    k = best_fit(held, length, window) if length < window else None
                    if k is None and length < window and len(held) >= most_open:
                        k = max(held, key=lambda w: (held[w], -w))
                        length = window - held[k]
                    if k is None:
                        k, following = following, following + 1
                        held[k], waiting[k] = 0, []
                    waiting[k].append((key, at, length, crc32(ids[at : at + length].tobytes()), n, k, held[k]))
                    held[k] += length
                    at += length
                    if held[k] == window:
                        del held[k]
                        done += waiting.pop(k)
                if len(done) >= 20_000:
                    yield rows(done, False)
                    done = []
        yield rows(done, False)
        yield rows([p for w in waiting.values() for p in w], True)

    pieces = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return merge(materialize(pieces.mapInArrow(run, STATE), "pieces"), window)


def merge(pieces: DataFrame, window: int) -> DataFrame:
    """All pieces, those of open windows packed anew: ``FAN_IN`` tasks' open windows at a time, so a group is bounded."""

    def group(rows: pa.Table) -> pa.Table:
        plain = {c: rows.column(c).fill_null(0).to_numpy() for c in ("length", "doc_id", "start", "part", "level")}
        nulls = rows.column("doc_id").is_null().to_numpy()
        order = np.lexsort((plain["part"], plain["start"], plain["doc_id"], nulls, -plain["length"]))
        following = MERGED + (int(plain["level"][0]) << 56) + (int(plain["part"][0]) << 28)
        held: dict[int, int] = {}
        used: dict[int, int] = {}
        ids, offsets = [], []
        for length in plain["length"][order].tolist():
            k = best_fit(held, length, window)
            if k is None:
                k, following = following, following + 1
                used[k] = 0
            ids.append(k)
            offsets.append(used[k])
            used[k] = held[k] = used[k] + length
            if held[k] >= window:
                del held[k]
        new = {"sequence_id": pa.array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()), "open": pa.array([used[k] < CLOSED * window for k in ids], pa.bool_())}
        rows = rows.take(pa.array(order))
        return pa.table({c: new[c] if c in new else rows.column(c) for c in [x.split()[0] for x in STATE.split(", ")]})

    finished = [pieces.where("not open")]
    left = pieces.where("open")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while parts > 1 or not level:
        parts = -(-parts // FAN_IN)
        step = left.withColumn("part", F.expr(f"part div {FAN_IN}")).withColumn("level", F.lit(level))
        step = materialize(step.groupBy("part").applyInArrow(group, STATE), "merged")
        finished.append(step.where("not open") if parts > 1 else step)
        left, level = step.where("open"), level + 1
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.select(*[x.split()[0] for x in PIECE.split(", ")])
