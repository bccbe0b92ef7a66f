"""Similarity join of texts on sets of word n-grams, by token-combination prefixes.

The tokens of a text are its distinct ``WIDTH``-word shingles, ordered rare class first, then by hash. Two sets that
reach the threshold differ in few tokens, so a prefix of each, longer by those, must meet. A rare token is a signature
by itself. Frequent tokens are dealt into groups by hash, and only pairs of a group are signatures: a pair is far rarer
than its tokens, at the price of a prefix extended by one token a group. Sets that share a signature are candidates;
size, position and a parity bitmap rule most out, exact overlaps decide the rest.

Equal sets are folded first. A signature's sets are compared with one of them; only where the links found leave several
components under one signature, pairs across components are made. So groups of near copies cost a line, not a square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.arrays import MULT, bounds, chunks, mix, shingles, signed, words
from plumbline.llm.common import prefilter, release, tidy
from plumbline.operators.graph import connected_components
from plumbline.plans.lineage import materialize

WIDTH = 5
# Similarity of 0.75: 4 * smaller >= 3 * larger, 7 * overlap >= 3 * (sum of sizes), 7 * difference <= sum of sizes.
# Counters that tell frequent tokens from rare ones: about one for so many bytes of text, up to a bound on what each
# task holds and sends. Only the work depends on them, never the result.
COUNTER_BYTES = 200
MOST_COUNTERS = 1 << 23
PARTS = 16
FAN_IN = 32
# Below this size every token is a signature by itself; above, a group holds about this many tokens of a set.
GROUP = 8
BITMAP = 8
# No token's hash, cut to 31 bits, is larger.
OPEN = (1 << 31) - 1
# Share of a prefix that must meet the set compared first. What this rules out is looked at among the pairs across
# components, so it steers the work only.
FIRST = 0.3
ROUNDS = 3


def token_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of a text column: first row, distinct token hashes in order, their rows, where each row begins."""
    for lo, hi, data, offsets in chunks(column):
        h, row, _, _ = words(data, offsets)
        tokens, of = shingles(h, row, hi - lo, width)
        order = np.lexsort((tokens, of))
        tokens, of = tokens[order], of[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
        tokens, of = tokens[new], of[new]
        yield lo, tokens, of, bounds(of, hi - lo)


def fold(values: np.ndarray, edge: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` over each row's values; 0 for a row without any."""
    out = np.zeros(len(edge) - 1, values.dtype)
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = ufunc.reduceat(values, edge[full])
    return out


def fingerprints(tokens: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """64 bits for each set. Different sets meet in one with a chance of 2 ** -64 a pair."""
    return mix(fold(mix(tokens ^ np.uint64(MULT)), edge, np.add))


def slot(tokens: np.ndarray, counters: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - (counters - 1).bit_length())).astype(np.int64)


def counters_for(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    return min(MOST_COUNTERS, max(1 << 12, 1 << (size // COUNTER_BYTES).bit_length()))


def describe(docs: DataFrame, key: str, text: str, width: int, counters: int) -> DataFrame:
    """A row per document (``key, n, fp`` and its parity bitmap ``b0 ...``) and rows of counters (``part, chunk, counts``)."""
    marks = ", ".join(f"b{i} long" for i in range(BITMAP))
    schema = f"key long, n long, fp long, {marks}, part long, chunk long, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int32)
        seen: list[np.ndarray] = []
        for batch in batches:
            for lo, tokens, _, edge in token_sets(batch.column(1), width):
                rows = len(edge) - 1
                seen.append(slot(tokens, counters).astype(np.int32))
                if sum(map(len, seen)) > counters:
                    counts += np.bincount(np.concatenate(seen), minlength=counters).astype(np.int32)
                    seen = []
                place = mix(tokens)
                word, bit = place & np.uint64(BITMAP - 1), np.uint64(1) << ((place >> np.uint64(8)) & np.uint64(63))
                columns = [pa.array(np.diff(edge).astype(np.int64)), pa.array(signed(fingerprints(tokens, edge)))]
                for i in range(BITMAP):
                    columns.append(pa.array(signed(fold(np.where(word == i, bit, np.uint64(0)), edge, np.bitwise_xor))))
                none = [pa.nulls(rows, t) for t in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), *columns, *none], names=names)
        if seen:
            counts += np.bincount(np.concatenate(seen), minlength=counters).astype(np.int32)
        part, n = TaskContext.get().partitionId(), counters // PARTS
        packed = [shrink(counts[i * n : (i + 1) * n]) for i in range(PARTS)]
        empty = [pa.nulls(PARTS, pa.int64()) for _ in range(3 + BITMAP)]
        own = [pa.array([part] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, *own], names=names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(tidy(run), schema), "sets")


def shrink(counts: np.ndarray) -> bytes:
    return pa.compress(np.minimum(counts, 65535).astype("<u2").tobytes(), codec="zstd", asbytes=True)


def grow(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=2 * n, codec="zstd", asbytes=True), "<u2").astype(np.int64)


def frequent_slots(described: DataFrame, counters: int) -> np.ndarray:
    """Which of the slots hold a frequent token: those clearly above what rare tokens alone would bring.

    The counters of all partitions are added ``FAN_IN`` at a time; what comes to the driver has a fixed size.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(grow(x, counters // PARTS) for x in frame["counts"])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "chunk": frame["chunk"].iloc[:1], "counts": [shrink(total)]})

    own = described.where("counts is not null").select("part", "chunk", "counts")
    parts = (described.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        own = own.withColumn("part", F.expr(f"part div {FAN_IN}"))
        own = own.groupBy("part", "chunk").applyInPandas(add, "part long, chunk long, counts binary")
    rows = sorted((r["chunk"], bytes(r["counts"])) for r in own.collect())
    if not rows:
        return np.zeros(counters, bool)
    total = np.concatenate([grow(c, counters // PARTS) for _, c in rows])
    usual = total.mean()
    return total > min(usual + 6 * usual**0.5 + 16, 65534)


def band(n: int) -> int:
    return n.bit_length() - 1


def frequent_signatures(rare: int, tokens: np.ndarray, n: int, need: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signatures from a set's frequent tokens (in hash order) and what each leaves of the set, for every partner's size.

    Sets are compared in the band of the smaller one, so a set has signatures in its own band and in those of its
    smaller partners. In a band every group hides at most one token, so the prefix ends when its tokens, less one for
    each group, are more than a partner may lack. What a signature leaves counts the tokens from its first on, and one
    more for every group before it, which may have hidden one.
    """
    out = []
    for b in range(band(-(-3 * n // 4)), band(n) + 1):
        if 1 << b < GROUP:
            more = tokens[: need - rare]
            out.append((more, n - rare - np.arange(len(more))))
            continue
        groups = (1 << b) // GROUP
        own = ((tokens >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        ordered, own = tokens[order], own[order]
        counted = rare
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for g, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True)):
            if counted >= need:
                break
            e = min(e, s + 1 + need - counted)
            counted += e - s - 1
            if e - s < 2:
                continue
            x, y = np.triu_indices(e - s, 1)
            with np.errstate(over="ignore"):
                pair = mix(ordered[s:e][x] * np.uint64(MULT) + ordered[s:e][y] + np.uint64(b))
            out.append((pair, n - rare - s - x + g))
    return out


def signatures(docs: DataFrame, text: str, width: int, frequent: np.ndarray) -> DataFrame:
    """``sig, fp, left, n, last`` of every set, once a task.

    ``left`` bounds the overlap with a set first met here; ``last`` is where the prefix ends in the order of hashes,
    ``OPEN`` if it goes on into the frequent tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent).tobytes())
    names = ["sig", "fp", "left", "n", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        counters = len(frequent)
        seen: set[int] = set()
        for batch in batches:
            for _, tokens, row, edge in token_sets(batch.column(0), width):
                n = np.diff(edge)
                fp = signed(fingerprints(tokens, edge))
                fresh = np.zeros(len(n), bool)
                for i, f in enumerate(fp.tolist()):
                    if f not in seen:
                        seen.add(f)
                        fresh[i] = True
                late = frequent[slot(tokens, counters)]
                order = np.lexsort((tokens, late, row))
                tokens, late = tokens[order], late[order]
                need = n // 4 + 1
                rare = fold((~late).astype(np.int64), edge, np.add)
                at = np.arange(len(tokens)) - edge[row]
                pick = fresh[row] & ~late & (at < need[row])
                sig, of, left = [tokens[pick]], [row[pick]], [n[row[pick]] - at[pick]]
                for r in np.flatnonzero(fresh & (n > 0) & (rare < need)).tolist():
                    own = tokens[edge[r] + rare[r] : edge[r + 1]]
                    for s, rest in frequent_signatures(int(rare[r]), own, int(n[r]), int(need[r])):
                        sig.append(s)
                        left.append(rest)
                        of.append(np.full(len(s), r))
                sig, of, left = np.concatenate(sig), np.concatenate(of), np.concatenate(left)
                last = np.full(len(n), OPEN, np.int32)
                ends = np.flatnonzero((n > 0) & (rare >= need))
                last[ends] = (tokens[edge[ends] + need[ends] - 1] >> np.uint64(33)).astype(np.int32)
                arrays = [signed(sig), fp[of], left.astype(np.int32), n[of].astype(np.int32), last[of]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    return docs.select(F.col(text).cast("string")).mapInArrow(tidy(run), "sig long, fp long, left int, n int, last int")


def sets_of(docs: DataFrame, key: str, text: str, width: int, reps: DataFrame) -> DataFrame:
    """``fp, tokens`` for the sets in ``reps`` (``fp, key``), read from the documents with those keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, _, edge in token_sets(batch.column(0), width):
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(signed(tokens)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(fingerprints(tokens, edge))), lists], names=["fp", "tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    text_key = F.coalesce(F.col("key"), F.lit(0))
    near = prefilter(rows, text_key, reps, text_key)
    wanted = reps.select(F.col("key").alias("k")).distinct()
    found = near.join(wanted, near["key"].eqNullSafe(wanted["k"]), "left_semi").select("text")
    # Rows with equal ids may hold other texts; those sets are not asked for.
    sets = found.mapInArrow(tidy(run), "fp long, tokens array<long>").join(reps.select("fp"), "fp", "left_semi")
    return materialize(sets.dropDuplicates(["fp"]), "tokens")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, folded: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of fingerprints whose sets reach the threshold."""
    marks = [f"b{i}" for i in range(BITMAP)]
    side = lambda s: folded.select(F.col("fp").alias(s), F.col("n").alias(f"n{s}"), *[F.col(m).alias(f"{m}{s}") for m in marks])
    differ = sum((F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in marks), F.lit(0))
    sizes = F.col("na") + F.col("nb")
    close = (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (7 * differ <= sizes)
    near = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b", sizes.alias("sizes")), "near")
    fps = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = sets_of(docs, key, text, width, folded.join(fps, "fp", "left_semi").select("fp", "key"))
    own = lambda s: sets.select(F.col("fp").alias(s), F.col("tokens").alias(f"t{s}"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    met = near.join(own("a"), "a").join(own("b"), "b").where(7 * overlap >= 3 * F.col("sizes"))
    return materialize(met.select("a", "b"), "links")


def most_overlap() -> Column:
    """Bound of a pair's overlap, from its ``k`` shared signatures.

    Of the two prefixes the one that ends first has all its common tokens among the signatures met, so at most these
    and what follows it are common. If both go on into the frequent tokens, what the first signature leaves is the bound.
    """
    after = lambda s: F.col("k") + F.col(f"n{s}") - F.expr(f"n{s} div 4") - 1
    return (
        F.when((F.col("lasta") == OPEN) & (F.col("lastb") == OPEN), F.col("left"))
        .when(F.col("lasta") < F.col("lastb"), after("a"))
        .when(F.col("lastb") < F.col("lasta"), after("b"))
        .otherwise(F.greatest(after("a"), after("b")))
    )


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable by links; a text without words (or null) has no shingles and links
    with nothing, not even its like. A text of fewer than ``width`` words has its whole sequence as one shingle.
    Repeated rows and equal sets share a component. Null ids are allowed and are nobody's smallest id while another
    exists. An empty table gives no rows; other columns are not read.
    """
    counters = counters_for(docs, text)
    described = describe(docs, key, text, width, counters)
    members = described.where("counts is null").select("key", "n", "fp")
    marks = [F.first(f"b{i}").alias(f"b{i}") for i in range(BITMAP)]
    folded = materialize(
        described.where("counts is null and n > 0").groupBy("fp").agg(F.min("key").alias("key"), F.first("n").alias("n"), *marks), "folded"
    )
    by_sig = Window.partitionBy("sig")
    rows = signatures(docs, text, width, frequent_slots(described, counters))
    rows = rows.withColumn("low", F.min("fp").over(by_sig)).withColumn("high", F.max("fp").over(by_sig))
    rows = rows.withColumn("held", F.count(F.lit(1)).over(by_sig).cast("int"))
    shared = materialize(rows.where("low < high").drop("low", "high"), "shared")
    # How much a set has in common with others: the middle of a group of near copies has most.
    weights = materialize(shared.groupBy("fp").agg(F.sum("held").alias("w")), "weights")

    def placed(component: DataFrame | None) -> DataFrame:
        if component is None:
            return shared.join(weights.withColumn("c", F.col("fp")), "fp")
        # Both have a row per set at most, so they are put side by side by grouping.
        none = F.lit(None).cast("long")
        both = weights.select("fp", "w", none.alias("c")).unionByName(component.select("fp", none.alias("w"), F.col("component").alias("c")))
        state = both.groupBy("fp").agg(F.max("w").alias("w"), F.max("c").alias("c")).where("w is not null")
        return shared.join(state.select("fp", "w", F.coalesce("c", "fp").alias("c")), "fp")

    # Each set is compared with one other under its signatures, in a few rounds with other ones in the middle.
    links, component = None, None
    for r in range(ROUNDS):
        priority = F.col("w") * (F.pmod(F.xxhash64("fp", F.lit(r)), F.lit(1000)) + 250)
        lead = F.max(F.struct(priority.alias("p"), "fp", "c")).over(by_sig)
        rows = placed(component).withColumn("lead", lead).where("lead.c != c")
        met = rows.groupBy("fp", F.col("lead.fp").alias("lead")).agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        best = met.where(F.col("k") >= FIRST / 4 * F.col("n")).groupBy("fp").agg(F.max(F.struct("k", "lead")).alias("b"))
        found = verified(best.select(F.col("fp").alias("a"), F.col("b.lead").alias("b")), docs, key, text, width, folded)
        links = found if links is None else links.unionByName(found)
        component = materialize(connected_components(links).select(F.col("node").alias("fp"), "component"), "component")
        release(docs.sparkSession)

    placed = placed(component).withColumn("low", F.min("c").over(by_sig)).withColumn("high", F.max("c").over(by_sig))
    mixed = materialize(placed.where("low < high").select("sig", "fp", "left", "n", "last", "c"), "mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    may = (F.col("x.c") < F.col("y.c")) & (4 * F.least("x.n", "y.n") >= 3 * F.greatest("x.n", "y.n"))
    # If both prefixes go on into the frequent tokens, the first common signature alone decides.
    open_ = (F.col("x.last") == OPEN) & (F.col("y.last") == OPEN)
    may &= ~open_ | (7 * F.least("x.left", "y.left") >= 3 * (F.col("x.n") + F.col("y.n")))
    both = x.join(y, F.col("x.sig") == F.col("y.sig")).where(may)
    across = (
        both.groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .agg(
            F.count(F.lit(1)).alias("k"), F.max(F.least("x.left", "y.left")).alias("left"),
            *[F.max(f"{s}.{c}").alias(f"{c}{t}") for s, t in (("x", "a"), ("y", "b")) for c in ("n", "last")],
        )
        .where(7 * most_overlap() >= 3 * (F.col("na") + F.col("nb")))
        .select("a", "b")
    )
    more = verified(across, docs, key, text, width, folded)
    component = connected_components(links.unionByName(more)).select(F.col("node").alias("fp"), "component")

    whole = folded.select("fp", "key").join(component, "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = whole.groupBy("c").agg(F.min("key").alias("component_id"))
    found = whole.select("fp", "c").join(least, "c").select("fp", "component_id")
    own = members.join(found, "fp", "left")
    return own.select(
        F.col("key").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )
