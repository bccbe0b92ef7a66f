"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and cut into blocks of equal numbers of words. The points
``frac(i * golden ratio)`` fall into the sources' cumulative weights, which gives slot ``i`` its source; the slots of a
source are ranked, and rank ``r`` takes the source's block ``r`` modulo its blocks, so a source starts anew once all its
blocks were taken. Column expressions only.

Running sums and ranks never need one task to hold a source: they are sums over buckets plus sums within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD
from plumbline.plans.lineage import materialize

# The golden ratio's fraction, and that of 2**20 times it: together they keep the points exact for large slot numbers.
GOLDEN = 0.6180339887498949
GOLDEN_20 = 648055.6485765612 % 1.0
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 4096
HEX = 3
SLOTS = 1 << 16


def source_key(source: Column) -> Column:
    """Orders by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``_rank`` (0 ...) in the order of ``key``, by range partitions and their sizes."""
    own = materialize(
        keys.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(
            "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")
        ),
        "ranked",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    return own.join(sizes, "_part").withColumn("_rank", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """``sk, source_size`` with ``weight, target``: shares of ``share`` times all words, none above ``most`` times its source.

    What a full source can't take is reshared by weight among the others until none is above. Each round is one
    aggregate over the sources; three numbers come to the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked(sources, "sk").withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most
    total, all_weights = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    want, level, free = share * total, 0.0, -1
    left, capped = all_weights, 0
    while left and left != free:
        free, level = left, (want - capped) / left
        full = F.lit(level) * F.col("weight") > cap
        left, capped = table.agg(
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0))
        ).first()
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def shuffled(docs: DataFrame, key: Column, size: Column) -> DataFrame:
    """One row per document: ``doc_key, source, sk, size, start``; ``start`` counts its source's words before it.

    The order within a source is that of the md5 of the key, so every run agrees; equal keys follow each other by size.
    """
    sized = materialize(
        docs.select(key.alias("doc_key"), F.col("source"), size.cast("long").alias("size"))
        .withColumn("sk", source_key(F.col("source")))
        .withColumn("h", F.md5(F.coalesce(F.col("doc_key").cast("string"), F.lit("")))),
        "sized",
    ).withColumn("bucket", F.substring("h", 1, HEX))
    cells = sized.groupBy("sk", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("sk", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sk", "bucket").orderBy("h", "doc_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return materialize(
        placed.join(offsets, ["sk", "bucket"]).select(
            "doc_key", "source", "sk", "size", (F.col("before") + F.col("inside")).alias("start")
        ),
        "shuffled",
    )


def schedule(plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``slot, sk, rank, block, words`` from ``sk, source_size, target, _rank``: which block each slot takes, and how much.

    Slots beyond a source's need are left out. A source whose interval is too narrow for the points gets the missing
    ranks in slots after all others.
    """
    need = F.round("target").cast("long")
    sized = plan.where("source_size > 0").select("*", need.alias("need")).where("need > 0")
    sized = sized.withColumn("blocks", F.ceil(F.col("source_size") / block))
    rest = F.col("need") % F.col("source_size")
    sized = sized.withColumn("slots", (F.expr("need div source_size") * F.col("blocks") + F.ceil(rest / block)).cast("long"))
    sized = materialize(sized, "plan")
    n_sources, n = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    grid = 64 + 4 * n_sources
    part = Window.partitionBy("_part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sized.groupBy("_part").agg(F.sum("slots").alias("s")).select("_part", F.coalesce(F.sum("s").over(parts), F.lit(0)).alias("earlier"))
    low = F.coalesce(F.sum("slots").over(part), F.lit(0))
    spans = sized.withColumn("low", low).join(earlier, "_part").withColumn("low", F.col("low") + F.col("earlier"))
    spans = spans.select("sk", "slots", (F.col("low") / max(n, 1)).alias("lo"), ((F.col("low") + F.col("slots")) / max(n, 1)).alias("hi"))
    cell = lambda x: F.floor(x * grid)
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(grid - 1)))))

    spark = plan.sparkSession
    i = F.col("id")
    point = F.pmod(F.pmod(F.shiftright(i, 20) * F.lit(GOLDEN_20), F.lit(1.0)) + F.pmod(i % (1 << 20) * F.lit(GOLDEN), F.lit(1.0)), F.lit(1.0))
    slots = spark.range(n).select(i.alias("slot"), point.alias("x"))
    slots = slots.withColumn("cell", F.least(cell(F.col("x")), F.lit(grid - 1)))
    drawn = materialize(
        slots.join(spans, "cell").where("x >= lo and x < hi").select("slot", "sk", F.expr(f"slot div {SLOTS}").alias("run")), "slots"
    )
    runs = drawn.groupBy("sk", "run").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("sk").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("sk", "run", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("sk", "run").orderBy("slot")) - 1
    ranks = drawn.withColumn("place", place).join(offsets, ["sk", "run"])
    ranks = ranks.select("slot", "sk", (F.col("place") + F.col("before")).alias("rank"))
    got = runs.groupBy("sk").agg(F.sum("k").alias("got"))
    short = (
        sized.join(got, "sk", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
        .select("sk", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank"))
        .select((F.lit(n) + F.col("rank")).alias("slot"), "sk", "rank")
    )
    all_ranks = ranks.unionByName(short).join(sized.select("sk", "slots", "blocks", "need", "source_size"), "sk").where("rank < slots")
    number = F.col("rank") % F.col("blocks")
    # Words of the source's sequence before this block, in this turn through the source and in all turns before it.
    passed = F.expr("rank div blocks") * F.col("source_size") + number * block
    words = F.least(F.lit(block), F.col("source_size") - number * block, F.col("need") - passed)
    return all_ranks.select("slot", "sk", "rank", number.alias("block"), words.alias("words"))


def mix(
    docs: DataFrame,
    key: Column,
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: ``doc_key, source, size, source_size, target, taken``.

    ``taken`` counts the document's words in the mix, repeats included: the overlap of its words with the blocks that
    the schedule takes. It is a whole number of copies plus, for the one document in which a source's need ends, its
    first words. Null texts have no words; a null source is a source of its own, last in order; repeated rows are
    mixed as separate documents; an empty table gives no rows. Other columns are not read.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)) if size is None else size
    placed = shuffled(docs, key, words)
    sources = placed.groupBy("sk").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sources, weights, share, most), "targets")
    slots = schedule(plan, block)
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("doc_key", "source", "sk", "size", "start", "block", begin.alias("a"), end.alias("b"))
    # A block is taken at most as often as its source may repeat, so each piece meets that many slots at most.
    met = pieces.join(slots.select("sk", "block", "words"), ["sk", "block"], "left")
    got = F.greatest(F.least("b", F.coalesce("words", F.lit(0))) - F.col("a"), F.lit(0))
    taken = met.groupBy("doc_key", "source", "sk", "size", "start").agg(F.coalesce(F.sum(got), F.lit(0)).alias("taken"))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    rows = taken.unionByName(none)
    return rows.join(plan.select("sk", "source_size", "target"), "sk").select(
        "doc_key", "source", "size", "source_size", "target", "taken"
    )
