"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders are mixed with weights that depend on how often the context was seen. The
weights are learned by expectation-maximisation on a held-out part of the training texts, against the counts of the
rest.

Counts and the texts that ask for them stay distributed. A task packs its texts into chunks: the texts as numbers of the
chunk's words, and for each order the chunk's distinct n-grams as sorted hashes, cut by hash range. Those of one range
meet in a group, are counted, and every chunk gets back the counts it asked for; frequent n-grams cost a range one
entry a chunk, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import MULT, chunks, mix, words
from plumbline.plans.lineage import materialize

ORDER = 2
CHUNK_BYTES = 10 << 20
RANGE_BYTES = 8 << 20
# An n-gram's count is touched by another's with a chance of about 2 ** -SPARE; words have all 64 bits.
SPARE = 20
END, BOS = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179
TRAIN, HELD_IN, OUT = 0, 1, 2
BUCKETS = 24
ROUNDS = 20


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes; small ones leave the upper planes empty."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def ngrams(tokens: np.ndarray, first: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each token; before a text's first token stand ``BOS``.

    ``first`` marks the texts' first tokens. Hashes of two and more words keep ``bits`` bits.
    """
    out = [tokens]
    with np.errstate(over="ignore"):
        past = [tokens]
        since = np.arange(len(tokens)) - np.maximum.accumulate(np.where(first, np.arange(len(tokens)), 0))
        for k in range(1, order):
            before = np.full(len(tokens), BOS, np.uint64)
            inside = np.flatnonzero(since >= k)
            before[inside] = tokens[inside - k]
            past.append(before)
            total = np.zeros(len(tokens), np.uint64)
            for p in past:
                total = total * np.uint64(MULT) + mix(p)
            out.append(mix(total) >> np.uint64(64 - bits))
    return out


def pack(docs: DataFrame, order: int, bits: int, ranges: int) -> DataFrame:
    """Chunks of texts (``tokens`` is set) and their requests (``hashes`` is set), from ``key, part, text``."""
    schema = "chunk long, part int, k int, range int, hashes binary, counts binary, keys array<long>, sizes binary, vocabulary binary, tokens binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[int, list] = {}

        def flush(part: int) -> pa.RecordBatch:
            nonlocal number
            keys, sizes, parts = held.pop(part)[:3]
            size = np.concatenate(sizes)
            stream = np.concatenate(parts)
            del parts
            first = np.zeros(len(stream), bool)
            first[np.cumsum(size) - size] = True
            vocabulary, local, count = np.unique(stream, return_inverse=True, return_counts=True)
            rank = np.argsort(-count, kind="stable")
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank), dtype=np.uint32)
            rows = [(number, part, None, None, None, None, [k for x in keys for k in x], squeeze(size), squeeze(vocabulary[rank]), squeeze(place[local]))]
            del local, place, rank
            for k, grams in enumerate(ngrams(stream, first, order, bits), 1):
                found, count = (vocabulary, count) if k == 1 else np.unique(grams, return_counts=True)
                width = 64 if k == 1 else bits
                cut = np.searchsorted(found, [(r << width) // ranges for r in range(1, ranges)]) if ranges > 1 else []
                edge = [0, *map(int, cut), len(found)]
                for r in range(ranges):
                    a, b = edge[r], edge[r + 1]
                    if b > a:
                        steps = np.diff(found[a:b], prepend=np.uint64(0))
                        rows.append((number, part, k, r, squeeze(steps), squeeze(count[a:b].astype(np.uint32)), None, None, None, None))
            number += 1
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(2)):
                h, row, _, _ = words(data, offsets)
                h[h == 0] = 1
                n = np.bincount(row, minlength=hi - lo)
                for part in np.unique(kinds[lo:hi]).tolist():
                    mine = np.flatnonzero(kinds[lo:hi] == part)
                    size = n[mine] + 1
                    stream = np.full(size.sum(), END, np.uint64)
                    text = np.ones(len(stream), bool)
                    text[np.cumsum(size) - 1] = False
                    stream[text] = h[np.isin(row, mine)] if len(mine) < hi - lo else h
                    own = held.setdefault(part, [[], [], [], 0])
                    own[0].append([keys[lo + r] for r in mine])
                    own[1].append(size)
                    own[2].append(stream)
                    own[3] += int((offsets[mine + 1] - offsets[mine]).sum()) + 8 * len(mine)
                    if own[3] >= CHUNK_BYTES:
                        yield flush(part)
        for part in sorted(held):
            yield flush(part)

    return materialize(docs.select("key", "part", "text").mapInArrow(run, schema), "chunks")


def count(packed: DataFrame) -> DataFrame:
    """Answers to the requests: ``chunk, k, range, train, held_in``, and rows of totals (``total`` is set)."""
    schema = "chunk long, k int, range int, train binary, held_in binary, total array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def answer(group: pa.Table) -> pa.Table:
        parts = group.column("part").to_pylist()
        k, r = group.column("k")[0].as_py(), group.column("range")[0].as_py()
        asked = [np.cumsum(unsqueeze(x, np.uint64)) for x in group.column("hashes").to_pylist()]
        n = [unsqueeze(x, np.uint32) for x in group.column("counts").to_pylist()]
        found, where = np.unique(np.concatenate(asked), return_inverse=True)
        edge = np.cumsum([0, *map(len, asked)])
        sums = []
        for kind in (TRAIN, HELD_IN):
            weight = np.concatenate([x if p == kind else np.zeros(len(x), np.uint32) for x, p in zip(n, parts, strict=True)])
            sums.append(np.bincount(where, weight, len(found)).astype(np.int64))
        train, held_in = sums
        rows = []
        for i, chunk in enumerate(group.column("chunk").to_pylist()):
            own = where[edge[i] : edge[i + 1]]
            rows.append((chunk, k, r, squeeze(train[own]), squeeze(held_in[own]), None))
        rows.append((None, k, r, None, None, [int(train.sum()), int((train > 0).sum()), int(held_in.sum()), int((train + held_in > 0).sum())]))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    requests = packed.where("hashes is not null").select("chunk", "part", "k", "range", "hashes", "counts")
    return materialize(requests.groupBy("k", "range").applyInArrow(answer, schema), "counts")


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each doubling of its frequency."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


class Chunk:
    """A chunk's texts with the counts it was answered: per token the counts of its n-grams and of their contexts."""

    def __init__(self, chunk: pa.Table, answers: pa.Table, order: int, bits: int, with_held_in: bool) -> None:
        self.keys = chunk.column("keys")[0].as_py()
        self.size = unsqueeze(chunk.column("sizes")[0].as_py(), np.int64)
        vocabulary = unsqueeze(chunk.column("vocabulary")[0].as_py(), np.uint64)
        stream = vocabulary[unsqueeze(chunk.column("tokens")[0].as_py(), np.uint32)]
        self.start = np.cumsum(self.size) - self.size
        first = np.zeros(len(stream), bool)
        first[self.start] = True
        by_order: dict[int, list] = {}
        for k, r, train, held_in in zip(*(answers.column(c).to_pylist() for c in ("k", "range", "train", "held_in")), strict=True):
            by_order.setdefault(k, []).append((r, train, held_in))
        self.count, self.context = [], []
        for k, grams in enumerate(ngrams(stream, first, order, bits), 1):
            parts = sorted(by_order[k])
            known = np.concatenate([unsqueeze(t, np.int64) for _, t, _ in parts])
            if with_held_in:
                known = known + np.concatenate([unsqueeze(h, np.int64) for _, _, h in parts])
            _, where = np.unique(grams, return_inverse=True)
            self.count.append(known[where])
            if k == 1:
                # Every counted text has one end; as often stood the beginning of a text before a word.
                texts = int(self.count[0][stream == END][0])
            if k < order:
                shifted = np.empty(len(stream), np.int64)
                shifted[1:] = self.count[-1][:-1]
                shifted[first] = texts
                self.context.append(shifted)


def learn(packed: DataFrame, counts: DataFrame, order: int, bits: int, n: int, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights ``[buckets, order + 1]`` (uniform, words, pairs, ...) from the held-in chunks.

    Tokens with equal counts are one event; each round of expectation-maximisation is one sum over the events.
    """
    cols = [f"c{k}" for k in range(1, order + 1)] + [f"x{k}" for k in range(2, order + 1)]
    schema = "bucket int, " + ", ".join(f"{c} long" for c in cols) + ", n long"

    def events(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int32()), *[pa.array([], pa.int64())] * (len(cols) + 1)], names=["bucket", *cols, "n"])
        own = Chunk(chunk, answers, order, bits, False)
        top = bucket(own.context[-1]) if own.context else np.zeros(own.size.sum(), np.int64)
        # A context matters only where the n-gram was seen.
        rows = np.stack([top, *own.count, *(np.where(c > 0, x, 0) for c, x in zip(own.count[1:], own.context, strict=True))], axis=1)
        found, times = np.unique(rows, axis=0, return_counts=True)
        arrays = [pa.array(found[:, 0].astype(np.int32)), *(pa.array(found[:, i + 1]) for i in range(len(cols))), pa.array(times)]
        return pa.Table.from_arrays(arrays, names=["bucket", *cols, "n"])

    chunk = packed.where((F.col("part") == HELD_IN) & F.col("tokens").isNotNull()).select("chunk", "keys", "sizes", "vocabulary", "tokens")
    asked = counts.where("chunk is not null").join(chunk.select("chunk"), "chunk", "left_semi").select("chunk", "k", "range", "train", "held_in")
    found = chunk.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(events, schema)
    found = materialize(found.groupBy("bucket", *cols).agg(F.sum("n").alias("n")), "events")

    estimate = [F.lit(1.0 / (v + 1)), F.col("c1") / max(n, 1)]
    estimate += [F.when(F.col(f"x{k}") > 0, F.col(f"c{k}") / F.col(f"x{k}")).otherwise(0.0) for k in range(2, order + 1)]
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    seen = np.zeros(BUCKETS, bool)
    for _ in range(rounds):
        mine = [F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, j]]), F.col("bucket") + 1) * e for j, e in enumerate(estimate)]
        total = sum(mine[1:], mine[0])
        sums = found.groupBy("bucket").agg(*[F.sum(F.col("n") * m / total).alias(f"s{j}") for j, m in enumerate(mine)]).collect()
        new = weights.copy()
        for row in sums:
            got = np.array([row[f"s{j}"] for j in range(order + 1)])
            if got.sum() > 0:
                new[row["bucket"]] = got / got.sum()
                seen[row["bucket"]] = True
        moved = np.abs(new - weights).max()
        weights = new
        if moved < 1e-4:
            break
    # A bucket without events takes the weights of the nearest one with fewer occurrences; an unseen context has no pairs.
    for b in range(1, BUCKETS):
        if not seen[b] and seen[:b].any():
            weights[b] = weights[b - 1]
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(axis=1, keepdims=True)


def score(docs: DataFrame, remainder: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per text: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``remainder`` (0 ... 9, never null) deals the texts: 0 is held out from all learning, 1 learns the weights, all but 0
    are counted. A text's tokens are its words in lower case (A-Z) and one end; a null or empty text is an end alone.
    ``score`` is the model's log10 probability of the text, ``base_score`` that of smoothed word frequencies. Without
    training texts all counts are 0. Repeated rows are scored and counted each; null ids stay null; an empty table gives
    no rows; other columns are not read.
    """
    part = F.when(remainder == 0, OUT).when(remainder == 1, HELD_IN).otherwise(TRAIN)
    rows = docs.select(F.col(key).cast("long").alias("key"), part.alias("part"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] + 1
    bits = min(64, math.ceil(math.log2(size)) + SPARE)
    ranges = max(1, -(-size // RANGE_BYTES))
    packed = pack(rows, order, bits, ranges)
    counts = count(packed)
    totals = counts.where("total is not null and k = 1").agg(
        *[F.coalesce(F.sum(F.col("total")[i]), F.lit(0)) for i in range(4)]
    ).first()
    n_rest, v_rest, n_held, v = totals
    n = n_rest + n_held
    weights = learn(packed, counts, order, bits, n_rest, v_rest)

    schema = f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def apply(group: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        own = Chunk(chunk, answers, order, bits, True)
        c = own.count[0]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        top = bucket(own.context[-1]) if own.context else np.zeros(len(c), np.int64)
        w = weights[top]
        p = w[:, 0] / (v + 1) + w[:, 1] * (c / max(n, 1))
        for k in range(1, order):
            x = own.context[k - 1]
            p += w[:, k + 1] * np.where(x > 0, own.count[k] / np.maximum(x, 1), 0.0)
        add = lambda a: np.add.reduceat(a, own.start)
        columns = [
            pa.array(own.keys, pa.int64()), pa.array([chunk.column("part")[0].as_py() == OUT] * len(own.size)), pa.array(own.size),
            pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(own.size), n)), pa.array(add(base)), pa.array(add(np.log10(p))),
        ]
        return pa.Table.from_arrays(columns, names=names)

    chunk = packed.where("tokens is not null").select("chunk", "part", "keys", "sizes", "vocabulary", "tokens")
    asked = counts.where("chunk is not null").select("chunk", "k", "range", "train", "held_in")
    return chunk.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(apply, schema)
