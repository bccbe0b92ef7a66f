"""Language identification by prediction by partial matching over bytes.

Per language a context tree of up to ``ORDER`` bytes holds how often each byte followed each context. A byte costs
``-log2(count / (total + kinds))`` in the longest known context; if it never followed there, an escape of
``-log2(kinds / (total + kinds))`` is paid and the next shorter context is asked, last of all a uniform one. The counts
are frozen after training, so a text's code length is an exact sum, and the language that codes it shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import MULT, chunks, mix, tables
from plumbline.llm.common import trim
from plumbline.plans.lineage import materialize

ORDER = 4
# Bytes of training text per language and in all, on average; texts are drawn by a hash of their key and text, longer
# ones than ``PIECE`` bytes in pieces, by one of ``DRAWS`` numbers each. Many languages share the whole alike.
TRAIN_BYTES = 3_000_000
ALL_BYTES = 24_000_000
PIECE = 1 << 14
DRAWS = 1 << 40
# Grams that a task counts together.
MOST = 1 << 20
# Bytes of evidence after which the score grows no more certain.
EVIDENCE = 64
UNKNOWN = "und"
# Bytes of text looked at together, and costs (one per gram and language) held together.
PART = 1 << 18
COSTS = 1 << 22


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts (A-Z in lower case) the number formed by it and the ``order`` bytes before it, and its row.

    Before a text stand ``order`` spaces.
    """
    _, lower, _, _ = tables()
    rows = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    padded = np.full(len(data) + order * rows + order, 32, np.uint8)
    at = np.arange(len(data)) + (row + 1) * order
    padded[at] = lower[data]
    code = np.zeros(len(data), np.uint64)
    for back in range(order, -1, -1):
        code = (code << np.uint64(8)) | padded[at - back]
    return code, row


def train(sample: DataFrame, order: int = ORDER) -> list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]]:
    """Counts per language and order from ``lang, text``, and if there, ``share, h``.

    Of a text longer than ``PIECE`` bytes the pieces drawn by ``h`` and their number with probability ``share`` count;
    others count whole. Grams are counted in the tasks before they are put together, so no task holds a language's texts.
    """
    if "h" not in sample.columns:
        sample = sample.withColumn("share", F.lit(1.0)).withColumn("h", F.lit(0).cast("long"))
    names = ["lang", "code", "n"]

    def drawn(data: np.ndarray, share: float, h: int) -> Iterator[tuple[int, int]]:
        if len(data) <= PIECE or share >= 1:
            yield 0, len(data)
            return
        begin = np.arange(0, len(data), PIECE)
        with np.errstate(over="ignore"):
            point = mix(np.arange(len(begin), dtype=np.uint64) * np.uint64(MULT) ^ np.uint64(h & 0xFFFFFFFFFFFFFFFF))
        for a in begin[(point >> np.uint64(24)).astype(np.float64) < share * DRAWS].tolist():
            yield a, min(a + PIECE, len(data))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, codes in held.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=names)
            held.clear()

        size = 0
        for batch in batches:
            langs, shares, hashes = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                for r in range(lo, hi):
                    own = data[offsets[r - lo] : offsets[r - lo + 1]]
                    for a, b in drawn(own, shares[r], hashes[r]):
                        # A very long text is read in parts, each with the bytes before it.
                        for c in range(a, b, PART):
                            first = max(0, c - order)
                            part = own[first : min(b, c + PART)]
                            held.setdefault(langs[r], []).append(grams(part, np.array([0, len(part)]), order)[0][c - first :])
                            size += len(part)
                            if size > MOST:
                                yield from emptied()
                                size = 0
        yield from emptied()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            which = langs.indices.to_numpy(zero_copy_only=False)
            rows = [(lang, code[which == i].tobytes(), n[which == i].tobytes()) for i, lang in enumerate(langs.dictionary.to_pylist())]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            types = (pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "grams", "counts"])

    counted = sample.select("lang", "text", "share", "h").mapInArrow(count, "lang string, code long, n long")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found: dict[str, list[tuple[bytes, bytes]]] = {}
    for lang, code, n in summed.mapInArrow(pack, "lang string, grams binary, counts binary").collect():
        found.setdefault(lang, []).append((bytes(code), bytes(n)))
    out = []
    for lang in sorted(found):
        code = np.frombuffer(b"".join(c for c, _ in found[lang]), np.int64).astype(np.uint64)
        n = np.frombuffer(b"".join(c for _, c in found[lang]), np.int64)
        levels = []
        for k in range(order + 1):
            keys, where = np.unique(code & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            levels.append((keys, np.bincount(where, n).astype(np.int64)))
        out.append((lang, levels))
    return out


class Sparse:
    """Per key the costs of those languages that have it: entries in key order, found by bisection."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, cost: np.ndarray) -> None:
        order = np.lexsort((lang, key))
        few = np.uint16 if lang.max(initial=0) < 1 << 16 else np.int32
        key, self.lang, self.cost = key[order], lang[order].astype(few), cost[order].astype(np.float32)
        self.keys, first = np.unique(key.astype(np.uint32) if key.max(initial=0) < 1 << 32 else key, return_index=True)
        self.edge = np.append(first, len(key)).astype(np.int32 if len(key) < 1 << 31 else np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the key, language and cost of every entry of the given keys."""
        none = np.zeros(0, np.int64)
        if not len(self.keys):
            return none, none, none
        # A key too large for the narrow type is none of them.
        narrow = keys.astype(self.keys.dtype)
        row = np.minimum(np.searchsorted(self.keys, narrow), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[row] == keys)
        first = self.edge[row[at]].astype(np.int64)
        size = self.edge[row[at] + 1] - first
        entry = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        return np.repeat(at, size), self.lang[entry], self.cost[entry]


class Model:
    """Frozen statistics of all languages: per order the cost of each language's own grams, and of an escape from its contexts.

    A gram costs a language that lacks it the escape from the context, if it has that, and what the gram costs in the
    next shorter context; so only what a language has seen is held.
    """

    def __init__(self, trained: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]], order: int = ORDER) -> None:
        self.order, self.langs = order, [lang for lang, _ in trained]
        self.cost: list[Sparse] = []
        self.escape: list[Sparse] = []
        none = [np.zeros(0, np.uint64)]
        for k in range(order + 1):
            known, leave = [], []
            for j, (_, levels) in enumerate(trained):
                code, n = levels[k]
                above, where, kinds = np.unique(code >> np.uint64(8), return_inverse=True, return_counts=True)
                total = np.bincount(where, n, len(above)) + kinds
                known.append((code, np.full(len(code), j), -np.log2(n / total[where])))
                leave.append((above, np.full(len(above), j), -np.log2(kinds / total)))
            for found, out in ((known, self.cost), (leave, self.escape)):
                out.append(Sparse(*(np.concatenate([x[i] for x in found] or none) for i in range(3))))

    def lengths(self, code: np.ndarray, order: int) -> np.ndarray:
        """Bits that each language needs for the last byte of each gram after the ``order`` bytes before it."""
        out = np.full((len(code), len(self.langs)), 8, np.float32)
        for k in range(order + 1):
            own = code & np.uint64((1 << 8 * (k + 1)) - 1)
            at, lang, cost = self.escape[k].find(own >> np.uint64(8))
            out[at, lang] += cost
            at, lang, cost = self.cost[k].find(own)
            out[at, lang] = cost
        return out

    def totals(self, code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Bits that each language needs for each of ``rows`` texts, of the grams of each in order."""
        out = np.zeros((rows, len(self.langs)))
        kinds, where = np.unique(code, return_inverse=True)
        step = max(1, COSTS // max(1, len(self.langs)))
        if len(kinds) <= step:
            costs = self.lengths(kinds, self.order)
        for a in range(0, len(code), step):
            cost = costs[where[a : a + step]] if len(kinds) <= step else self.lengths(code[a : a + step], self.order)
            part = row[a : a + step]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out[part[starts]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, learnt_from: Column, key: Column, order: int = ORDER, train_bytes: int = TRAIN_BYTES, all_bytes: int = ALL_BYTES) -> Model:
    """The model from ``text, lang`` of the rows that ``learnt_from`` marks.

    Each language's share of texts is drawn by a hash of ``key`` and text so that about ``train_bytes`` of it are read,
    of texts longer than ``PIECE`` bytes a share of the pieces; a language with less is read whole. Where that would
    be more than ``all_bytes`` of all languages, each gets an equal part of these, so the model is bounded and every
    label is learned. Rows that repeat whole are drawn together, but add no grams.
    """
    labelled = docs.where(learnt_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    # Languages of little text leave their part of the whole to the others only where all of them fit.
    known = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.col("bytes"), F.lit(train_bytes))).alias("bytes")).first()
    if (known["bytes"] or 0) > all_bytes:
        train_bytes = all_bytes // known["n"]
    share = F.least(F.lit(1.0), F.lit(float(train_bytes)) / F.greatest("bytes", F.lit(1)))
    # One row a language: stored, so that it is sent to the texts as long as it is small.
    shares = materialize(sizes.select("lang", share.alias("share")), "shares")
    point = F.pmod(F.col("h"), F.lit(DRAWS))
    drawn = (F.octet_length("text") > PIECE) | (point < F.col("share") * DRAWS)
    hashed = labelled.select("lang", "text", F.xxhash64(key, F.col("text")).alias("h"))
    sample = hashed.join(shares, "lang").where(drawn).select("lang", "text", "share", "h")
    model = Model(train(sample, order), order)
    trim()
    return model


def identify(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row, then ``lang_pred, score, bits_per_byte``, which replace columns of these names.

    ``score`` is the winner's share when every language gets ``2 ** -bits``, the bits scaled to ``EVIDENCE`` bytes of
    text at most. A null text, one without any letter, and every text if no language was learned are ``und`` with
    score 0 and no bits. Ties go to the first language in order. Rows are independent: repeated rows, null ids and
    other columns play no part. Only the text goes to Python, only the verdict comes back. Memory is one slice of a
    batch and the model, which ``ALL_BYTES`` bounds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = "struct<lang_pred string, score double, bits_per_byte double>"

    def judged(column: pa.Array, letters: pa.Array) -> pa.Array:
        model = shared.value
        pred, score, bits = [], [], []
        letter = letters.to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in chunks(column, PART):
            size = np.diff(offsets)
            total = np.zeros((hi - lo, len(model.langs)))
            # A very long text is read in parts.
            for a in range(0, len(data) if model.langs else 0, PART):
                b = min(len(data), a + PART)
                first = max(0, a - model.order)
                cut = np.clip(offsets, first, b) - first
                code, row = grams(data[first:b], cut, model.order)
                total += model.totals(code[a - first :], row[a - first :], hi - lo)
            known = letter[lo:hi] & bool(model.langs)
            best = total.argmin(axis=1) if model.langs else np.zeros(hi - lo, int)
            least = total[np.arange(hi - lo), best] if model.langs else np.zeros(hi - lo)
            scale = np.minimum(1.0, EVIDENCE / np.maximum(size, 1))
            share = 1 / np.maximum(1, np.exp2(-(total - least[:, None]) * scale[:, None]).sum(axis=1))
            pred += [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            score += np.where(known, share, 0.0).tolist()
            bits += [x if ok else None for x, ok in zip((least / np.maximum(size, 1)).tolist(), known, strict=True)]
        arrays = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
        return pa.StructArray.from_arrays(arrays, names=["lang_pred", "score", "bits_per_byte"])

    # Not to be evaluated again in a filter on its result.
    judge = F.arrow_udf(judged, returnType=found).asNondeterministic()
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    names = [c for c in columns if c not in ("lang_pred", "score", "bits_per_byte")]
    rows = docs.select(*names, judge(F.col(text), has_letter).alias("_found"))
    return rows.select(*names, "_found.lang_pred", "_found.score", "_found.bits_per_byte")
