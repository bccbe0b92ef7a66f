"""How far a language's sources lie apart in their vocabulary, over the terms that enough documents hold.

Terms are found by refining prefixes: the first level counts, per language, the documents of every term's first bytes;
each further level counts longer prefixes of those terms only whose shorter prefix enough documents hold, until no
prefix is left to extend. Levels count 64-bit hashes of prefixes and tell the next level by a bitmap of fixed size:
equal hashes or slots let a prefix pass that should go, never the other way round. Terms that come through whole are
counted as strings in the end, and those below the threshold go, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.arrays import MULT, chunks, mix, places, span_hashes, tables, words
from plumbline.plans.lineage import materialize

DOCUMENTS = 30
RANKS = 50
# Bytes of the first prefixes; each level doubles them.
FIRST = 4
# Bits of a bitmap (8 MB). A full one prunes less, the result stays the same.
SLOTS = 1 << 26
PAGE = 32768
# Term occurrences that a task counts together, and bytes of a long text looked at together.
MOST = 1 << 20
PART = 1 << 22
# Spans of up to so many bytes are hashed a byte at a time, all at once.
SHORT = 16
# Low bits of a number that say which of the texts counted together; the rest holds the low bits of a hash.
ROW_BITS = 22
# Terms and sources of one comparison.
CHUNK, BLOCK = 1024, 32


def separators() -> np.ndarray:
    """ASCII characters that aren't letters, by byte."""
    out = np.zeros(256, bool)
    out[:128] = True
    out[65:91] = out[97:123] = False
    return out


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, A-Z as a-z; spans are in order and don't overlap."""
    value = tables()[3]
    longest = int((end - begin).max()) if len(begin) else 0
    if longest > SHORT:
        return span_hashes(data, begin, end, value)
    out = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(longest):
            at = begin + j
            inside = at < end
            out += value[data[np.minimum(at, end - 1)]] * inside * np.uint64(pow(MULT | 1, j, 1 << 64))
    return mix(out)


def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of about ``PART`` bytes; a longer text comes in several parts, cut between terms."""
    blank = separators()
    for lo, _, data, offsets in chunks(column, PART):
        a = 0
        while len(data) - a > 2 * PART:
            b, width = a + PART, 1 << 12
            while b < len(data) and not (gap := blank[data[b : b + width]]).any():
                b, width = b + width, width * 2
            b = min(len(data), b + int(np.argmax(gap))) if b < len(data) else len(data)
            yield lo, data[a:b], np.clip(offsets, a, b) - a
            a = b
        yield lo, data[a:], np.maximum(offsets, a) - a


def numbered(row: np.ndarray) -> np.ndarray:
    """Numbers from 0 on for the different values of ``row``, which is in order."""
    return np.cumsum(np.r_[False, row[1:] != row[:-1]]) if len(row) else row


def holders(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of each hash, without ``ROW_BITS``, and how many rows hold it; rows are in order.

    One sort of plain numbers puts a hash's rows side by side. More rows than the bits can tell come in pieces.
    """
    row = numbered(row)
    hashes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, int(row[-1]) + 1 if len(row) else 0, 1 << ROW_BITS):
        own = slice(*np.searchsorted(row, [a, a + (1 << ROW_BITS)]))
        pair = np.sort((h[own] << np.uint64(ROW_BITS)) | (row[own] - a).astype(np.uint64))
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]] >> np.uint64(ROW_BITS)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        hashes.append(pair[starts].view(np.int64))
        counts.append(np.diff(np.r_[starts, len(pair)]))
    return np.concatenate(hashes), np.concatenate(counts)


def salted(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h ^ (lang * np.uint64(MULT)))


def among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the slot of each hash is set."""
    slot = (h >> np.uint64(1)) & np.uint64(SLOTS - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmaps(found: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bitmaps of the whole terms and of the prefixes among ``h``, whose last bit tells them apart; whether there are prefixes."""
    slot = F.shiftright("h", 1).bitwiseAND(F.lit(SLOTS - 1)) + 1
    placed = found.select(F.col("h").bitwiseAND(F.lit(1)).alias("whole"), slot.alias("s"))
    pages = placed.groupBy("whole", F.bitmap_bucket_number("s").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = [np.zeros(SLOTS // 8, np.uint8), np.zeros(SLOTS // 8, np.uint8)]
    longer = False
    for row in pages.collect():
        at = (row["page"] - 1) * PAGE // 8
        out[row["whole"]][at : at + PAGE // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
        longer |= not row["whole"]
    return out[1], out[0], longer


def level(texts: DataFrame, documents: int, before: int, length: int, kept: np.ndarray | None) -> DataFrame:
    """Hashes of prefixes of ``length`` bytes, and of whole terms up to it, that ``documents`` texts of a language hold.

    Only terms longer than ``before`` count whose prefix of that length is ``kept``. The hash's last bit is 1 for whole terms;
    its first ``ROW_BITS`` are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        blank = separators()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        first = size = 0

        def counted() -> pa.RecordBatch:
            row, h = (np.concatenate([x[i] for x in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in holders(row, h.astype(np.uint64))], names=["h", "n"])

        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, data, offsets in parts(batch.column(1)):
                row, begin, end = places(data, offsets, blank)
                row = row + lo
                if bits is not None:
                    pick = np.flatnonzero(end - begin > before)
                    h = salted(spans(data, begin[pick], begin[pick] + before), lang[row[pick]])
                    pick = pick[among(bits, h)]
                    row, begin, end = row[pick], begin[pick], end[pick]
                h = salted(spans(data, begin, np.minimum(end, begin + length)), lang[row])
                h = (h & ~np.uint64(1)) | (end - begin <= length).astype(np.uint64)
                if len(offsets) == 2:
                    h = np.unique(h)
                held.append((first + row[: len(h)], h))
                size += len(h)
            first += len(batch.column(0))
            # Between batches no text is cut, so none is counted twice.
            if size > MOST:
                yield counted()
                held, size = [], 0
        yield counted()

    found = texts.select(F.xxhash64("lang").alias("l"), "text").mapInArrow(run, "h long, n long")
    return found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= documents).select("h")


def kept_terms(texts: DataFrame, documents: int, first: int) -> np.ndarray:
    """Bitmap of the whole terms that come through all levels."""
    whole, kept, longer = bitmaps(level(texts, documents, 0, first, None))
    length = first
    while longer:
        more, kept, longer = bitmaps(level(texts, documents, length, 2 * length, kept))
        whole |= more
        length *= 2
    return whole


def occurrences(texts: DataFrame, whole: np.ndarray, documents: int) -> DataFrame:
    """``lang, source, term, n, total``: occurrences in the source and in the language of the terms that are kept."""
    shared = texts.sparkSession.sparkContext.broadcast(whole)
    out = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        blank = separators()
        lower = tables()[1]
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        groups: dict[tuple[str, str], int] = {}
        first = size = 0

        def counted() -> pa.RecordBatch:
            names = list(groups)
            terms = pa.chunked_array([x[2] for x in held], pa.large_string()).combine_chunks()
            terms = (terms if isinstance(terms, pa.Array) else pa.array([], pa.large_string())).dictionary_encode()
            row, group = (np.concatenate([x[i] for x in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
            # Texts are numbered group by group, so one sort puts a term's groups, and in them its texts, side by side.
            row = numbered(row)
            of = group[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])] if len(row) else group
            order = np.argsort(of, kind="stable")
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of))
            width = len(of).bit_length()
            pair = np.sort(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) << width | rank[row])
            term, own = pair >> width, of[order][pair & ((1 << width) - 1)]
            new = np.ones(len(pair), bool)
            new[1:] = (term[1:] != term[:-1]) | (own[1:] != own[:-1])
            starts = np.flatnonzero(new)
            new[1:] = pair[1:] != pair[:-1]
            docs = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
            own = pa.array(own[starts])
            columns = [
                pa.array([n[0] for n in names], pa.string()).take(own), pa.array([n[1] for n in names], pa.string()).take(own),
                terms.dictionary.take(pa.array(term[starts])).cast(pa.string()),
                pa.array(np.diff(np.r_[starts, len(pair)]).astype(np.int64)), pa.array(docs),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            for lo, data, offsets in parts(batch.column(1)):
                h, row, begin, end = words(data, offsets, separator=blank)
                row = row + lo
                pick = np.flatnonzero(among(bits, salted(h, lang[row])))
                row, begin, end = row[pick], begin[pick], end[pick]
                # The terms' bytes side by side make one array of strings.
                length = end - begin
                places = np.r_[0, np.cumsum(length)]
                source = np.arange(places[-1]) + np.repeat(begin - places[:-1], length)
                terms = pa.LargeStringArray.from_buffers(len(pick), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(lower[data[source]]))
                held.append((first + row, group[row], terms))
                size += len(pick)
            first += len(batch.column(0))
            if size > MOST:
                yield counted()
                held, size, groups = [], 0, {}
        yield counted()

    found = texts.select(F.xxhash64("lang").alias("l"), "text", "lang", "source").mapInArrow(run, out)
    summed = materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = summed.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= documents)
    return materialize(summed.drop("docs").join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept")


def share(n: Column, of: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (of + 5 kinds)), exact; null without terms."""
    wide = (n + 5).cast("decimal(27,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return 1 + F.call_function("div", wide, F.nullif(of + 5 * kinds, F.lit(0)).cast("decimal(20,0)"))


def pair_differences(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each two sources of a language.

    Sources are compared in blocks and terms in chunks of bounded size. A source gives each term it lacks the same
    share ``none``, so only terms that one of a block's sources holds need a look; the others add |none - none| each.
    """
    n_blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("kinds") / CHUNK).cast("int"))
    placed = sizes.withColumn("blocks", n_blocks).withColumn("chunks", n_chunks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    own = counts.join(placed, ["lang", "source"])
    entries = own.select(
        "lang", "source", "term", share(F.col("n"), F.col("of"), F.col("kinds")).alias("p"), "none", "kinds", "blocks", "block",
        F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"),
    )
    # One row a source and chunk without a term, so that sources meet that hold nothing in it.
    marks = placed.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "none", "kinds", "blocks", "block",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )
    every = entries.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        lang = frame["lang"].iloc[0]
        source, names = pd.factorize(frame["source"])
        first = frame.groupby(source, sort=True).first()
        none = first["none"].to_numpy(np.int64)
        low, high = (first["block"] == frame[c].iloc[0] for c in ("low", "high"))
        has = frame["term"].notna().to_numpy()
        term, terms = pd.factorize(frame["term"][has])
        p = np.tile(none, (len(terms), 1))
        p[term, source[has]] = frame["p"][has].to_numpy(np.int64)
        out = []
        for i in np.flatnonzero(low):
            more = np.abs(p - p[:, i : i + 1]).sum(axis=0) - len(terms) * np.abs(none - none[i])
            for j in np.flatnonzero(high):
                if i != j:
                    base = int(first["kinds"].iloc[0]) * abs(int(none[i] - none[j]))
                    out += [(lang, names[a], names[b], int(more[j]), base) for a, b in ((i, j), (j, i))[: 1 + (not low[j])]]
        return pd.DataFrame(out, columns=["lang", "source", "item", "more", "base"])

    schema = "lang string, source string, item string, more long, base long"
    met = every.groupBy("lang", "chunk", "low", "high").applyInPandas(compare, schema)
    return met.groupBy("lang", "source", "item").agg((F.sum("more") + F.max("base")).alias("value"))


def audit(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS, first: int = FIRST) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source lies from the others of its language, and by which terms.

    A term is a run of letters, where all non-ASCII characters are letters; A-Z count as a-z. A language keeps the terms
    that at least ``documents`` of its rows hold. Part ``pair`` has every other source of the language, part ``term`` the
    ``ranks`` kept terms that the source uses most beyond its language. Null text, lang and source are empty strings;
    rows that repeat an id or repeat whole are documents of their own; a language without kept terms has pairs of value
    0. An empty table gives no rows; other columns are not read. The memory of a task is a million terms, two bitmaps,
    and ``CHUNK`` terms of two blocks of sources.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(plain("text"), plain("lang"), plain("source"))
    counts = occurrences(texts, kept_terms(texts, documents, first), documents)

    kept = counts.select("lang", "term", "total").distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("all_of"))
    filled = counts.groupBy("lang", "source").agg(F.sum("n").alias("of"))
    groups = texts.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    zero = {"of": 0, "kinds": 0, "all_of": 0}
    sizes = groups.join(filled, ["lang", "source"], "left").join(langs, "lang", "left").fillna(zero)
    sizes = sizes.join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang")
    none = F.coalesce(share(F.lit(0).cast("long"), F.col("of"), F.col("kinds")), F.lit(0)).alias("none")
    sizes = materialize(sizes.select("lang", "source", "of", "kinds", "all_of", "sources", none), "sources")

    pairs = pair_differences(counts, sizes)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))

    p = share(F.col("n"), F.col("of"), F.col("kinds"))
    q = share(F.col("total"), F.col("all_of"), F.col("kinds"))
    own = counts.join(sizes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
    terms = own.where("value > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(terms.withColumn("part", F.lit("term")).select(*names))
