"""Near-duplicate detection and set-similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.hashing import line_hash
from plumbline.operators.windows import top_per_group
from plumbline.plans.lineage import materialize
from plumbline.plans.skew import HEAVY_KEYS

# Defaults of the duplication lens.
MIN_RUN = 6
MIN_LINES = 8
FANOUT = 6
MIN_SIMILARITY = 0.4
KGRAM = 9
SKETCH_SIZE = 128
MIN_TOKENS = 120
OUT_PER_SIGNAL = 12
PROJECTION_MIN_FIELDS = 8
PROJECTION_MIN_SIMILARITY = 0.8
PROJECTION_ROWS = 20


def line_sequences(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, algorithm: str = "xxhash64"
) -> DataFrame:
    """``doc, seq, hashes``: ordered line hashes and their distinct set, per document with enough lines."""
    hashed = F.transform(tx.interesting_lines(F.col(text)), lambda l: line_hash(l, algorithm))
    record = F.transform(F.array(hashed), lambda s: F.struct(s.alias("seq"), F.array_distinct(s).alias("hashes")))
    # Exploding the one-element array keeps the hashing from being repeated for the filter and the set.
    kept = F.filter(record, lambda r: F.size(r["seq"]) >= min_lines)
    return docs.select(F.col(doc).alias("doc"), F.explode(kept).alias("r")).select("doc", "r.seq", "r.hashes")


def minhash_sketch(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    k: int = KGRAM,
    size: int = SKETCH_SIZE,
    min_tokens: int = MIN_TOKENS,
    algorithm: str = "xxhash64",
) -> DataFrame:
    """``doc, hashes``: the ``size`` smallest distinct shingle hashes of the token stream."""
    enough = F.filter(F.array(tx.raw_tokens(F.col(text))), lambda t: F.size(t) >= min_tokens)
    # Digits of one length stand in the order of their numbers, so only the smallest are made numbers.
    hashed = (lambda s: F.substring(F.md5(s), 1, 15)) if algorithm == "md5" else (lambda s: line_hash(s, algorithm))
    sketch = F.transform(
        enough,
        lambda t: F.slice(F.sort_array(F.array_distinct(F.transform(tx.shingles(tx.normal_tokens(t), k), hashed))), 1, size),
    )
    if algorithm == "md5":
        sketch = F.transform(sketch, lambda hs: F.transform(hs, lambda h: F.conv(h, 16, 10).cast("bigint")))
    return docs.select(F.col(doc).alias("doc"), F.explode(sketch).alias("hashes"))


def equal_documents(features: DataFrame) -> DataFrame:
    """``doc, rep``: each document and the smallest one with the same features (all columns but ``doc``)."""
    same = [c for c in features.columns if c != "doc"]
    keyed = features.select("doc", F.xxhash64(*same).alias("_f"), F.xxhash64(F.lit(1), *same).alias("_g"))
    reps = keyed.groupBy("_f", "_g").agg(F.min("doc").alias("rep"))
    return keyed.join(reps, ["_f", "_g"]).select("doc", "rep")


def hash_groups(doc_hashes: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``h, docs, first_doc``: distinct documents per hash, equal ones folded into one.

    One row per hash whatever its spread; those above a fan-out are the lines that many texts share.
    """
    members = equal_documents(doc_hashes) if members is None else members
    single = doc_hashes.join(members.where("doc = rep").select("doc"), "doc", "left_semi")
    rows = single.select("doc", F.explode("hashes").alias("h"))
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first_doc"))


def candidate_pairs(doc_hashes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``a, b`` (a < b): documents sharing a hash held by 2..``fanout`` different documents, and equal documents.

    ``doc_hashes`` is ``doc, hashes`` and may hold further features. Documents
    with equal features are folded first: each is paired with the smallest of
    them, which alone counts for the fan-out and meets the others, so any number
    of copies is found in one row each. A hash held by more documents is
    boilerplate by definition; ``hash_groups`` lists those. Frequencies combine
    map-side; the most frequent boilerplate hashes (a bounded list) are dropped
    by a broadcast anti join before anything is shuffled by hash. What remains
    has at most ``fanout`` documents per hash, hence at most
    ``fanout * (fanout - 1) / 2`` pairs.
    """
    members = materialize(equal_documents(doc_hashes), "members")
    single = doc_hashes.join(members.where("doc = rep").select("doc"), "doc", "left_semi")
    rows = single.select("doc", F.explode("hashes").alias("h"))
    freq = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    boilerplate = freq.where(F.col("df") > fanout).orderBy(F.col("df").desc(), "h").limit(HEAVY_KEYS).select("h")
    narrow = freq.where(F.col("df").between(2, fanout)).select("h")
    kept = rows.join(F.broadcast(boilerplate), "h", "left_anti").join(narrow, "h")
    groups = kept.groupBy("h").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    pairs = F.flatten(
        F.transform(
            "docs",
            lambda a, i: F.transform(
                F.slice(F.col("docs"), i + F.lit(2), F.size("docs")), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    met = groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    return met.unionByName(members.where("doc != rep").select(F.col("rep").alias("a"), F.col("doc").alias("b")))


def with_sets(pairs: DataFrame, sets: DataFrame, column: str, left: str, right: str) -> DataFrame:
    """Attach one array column of both documents to each pair (NULL when a document has none)."""
    a = sets.select(F.col("doc").alias("a"), F.col(column).alias(left))
    b = sets.select(F.col("doc").alias("b"), F.col(column).alias(right))
    return pairs.join(a, "a", "left").join(b, "b", "left")


def overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, shared, overlap``: shared distinct hashes and their share of the smaller set."""
    both = with_sets(pairs, sets, "hashes", "_sa", "_sb")
    shared = F.coalesce(F.size(F.array_intersect("_sa", "_sb")), F.lit(0))
    present = F.col("_sa").isNotNull() & F.col("_sb").isNotNull()
    return (
        both.withColumn("shared", F.when(present, shared).otherwise(F.lit(0)).cast("bigint"))
        .withColumn(
            "overlap", F.when(present, F.col("shared") / F.least(F.size("_sa"), F.size("_sb"))).otherwise(F.lit(0.0))
        )
        .drop("_sa", "_sb")
    )


def sketch_jaccard(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Adds ``token_sim``: Jaccard of the two sketches; 0 when either is missing."""
    both = with_sets(pairs, sketches, "hashes", "_ka", "_kb")
    present = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    inter = F.size(F.array_intersect("_ka", "_kb"))
    return both.withColumn(
        "token_sim",
        F.when(present, inter / (F.size("_ka") + F.size("_kb") - inter)).otherwise(F.lit(0.0)),
    ).drop("_ka", "_kb")


def _joined(ranks: Column, step: Column) -> Column:
    """One number for each two runs that start ``step`` apart."""
    left = F.slice(ranks, F.lit(1), F.greatest(F.size(ranks) - step, F.lit(0)))
    return F.transform(left, lambda x, i: F.xxhash64(x, F.get(ranks, i + step)))


def common_run(a: Column, b: Column) -> Column:
    """Length of the longest contiguous stretch that two arrays of hashes share, in about ``n log n`` steps.

    Prefix doubling: a run of ``2 w`` elements is numbered by the numbers of its two halves. Both arrays' numbers are
    doubled as long as they have one in common; between the last such width and its double the longest shared length
    is bisected, as a run of ``w + d`` elements is two of ``w`` that start ``d`` apart.
    """
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(F.least(F.size(a), F.size(b)), F.lit(2)))).cast("int"))
    state = lambda x, y, w, more: F.struct(x.alias("a"), y.alias("b"), w.alias("w"), more.alias("more"))

    def double(s: Column, _: Column) -> Column:
        wider = F.struct(_joined(s["a"], s["w"]).alias("a"), _joined(s["b"], s["w"]).alias("b"))
        meets = lambda n: F.when(
            F.arrays_overlap(n["a"], n["b"]), state(n["a"], n["b"], s["w"] * 2, F.lit(True))
        ).otherwise(state(s["a"], s["b"], s["w"], F.lit(False)))
        return F.when(s["more"], tx.bind(wider, meets)).otherwise(s)

    def bisect(s: Column) -> Column:
        def narrow(d: Column, j: Column) -> Column:
            half = F.call_function("shiftright", s["w"], j)
            longer = F.arrays_overlap(_joined(s["a"], d + half), _joined(s["b"], d + half))
            return F.when((half > 0) & longer, d + half).otherwise(d)

        return s["w"] + F.aggregate(rounds, F.lit(0), narrow)

    widest = F.aggregate(rounds, state(a, b, F.lit(1), F.lit(True)), double)
    return F.when(F.arrays_overlap(a, b), tx.bind(widest, bisect)).otherwise(F.lit(0)).cast("bigint")


def longest_common_run(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adds ``run``: the longest contiguous block of equal lines of both documents; 0 for a document without lines.

    Both line arrays meet in the pair's row, and the work there grows with their length, not with the number of equal
    lines of both, so texts that repeat one line many times cost no more than others.
    """
    both = with_sets(pairs.select("a", "b").distinct(), sequences, "seq", "_sa", "_sb")
    runs = both.select("a", "b", common_run(F.col("_sa"), F.col("_sb")).alias("run"))
    return pairs.join(runs, ["a", "b"], "left").withColumn("run", F.coalesce("run", F.lit(0).cast("bigint")))


def duplicate_scores(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    min_run: int = MIN_RUN,
    min_sim: float = MIN_SIMILARITY,
    min_lines: int = MIN_LINES,
    fanout: int = FANOUT,
    min_tokens: int = MIN_TOKENS,
    sketch_algorithm: str = "xxhash64",
) -> DataFrame:
    """``a, b, shared, overlap, token_sim, run, via`` of every flagged pair.

    The run is computed for every pair that shares enough lines.
    """
    # Both feature tables feed several joins; the texts are read and hashed once.
    sequences = materialize(line_sequences(docs, doc, text, min_lines), "line-sequences")
    sketches = materialize(minhash_sketch(docs, doc, text, min_tokens=min_tokens, algorithm=sketch_algorithm), "sketches")
    pairs = candidate_pairs(sequences, fanout).unionByName(candidate_pairs(sketches, fanout)).distinct()
    scored = sketch_jaccard(overlap(pairs, sequences), sketches)
    scored = materialize(scored, "scored")
    literal = scored.where(F.col("shared") >= min_run)
    rest = scored.where(F.col("shared") < min_run)
    runs = longest_common_run(literal, sequences).unionByName(rest.withColumn("run", F.lit(0).cast("bigint")))
    by_lines = F.col("run") >= min_run
    by_tokens = F.col("token_sim") >= min_sim
    return runs.withColumn(
        "via", F.when(by_lines & by_tokens, "both").when(by_tokens, "structural").when(by_lines, "lines")
    ).where(F.col("via").isNotNull())


def duplicates(flagged: DataFrame, out: int = OUT_PER_SIGNAL) -> DataFrame:
    """Report list: the top pairs of each signal, each pair once."""
    lines = flagged.where(F.col("via") != "structural").orderBy(
        F.col("run").desc(), F.col("shared").desc(), "a", "b"
    ).limit(out)
    structural = flagged.where(F.col("via") != "lines").orderBy(F.col("token_sim").desc(), "a", "b").limit(out)
    order = F.when(F.col("via") == "both", 0).when(F.col("via") == "structural", 1).otherwise(2)
    return (
        structural.unionByName(lines)
        .dropDuplicates(["a", "b"])
        .orderBy(order, F.col("token_sim").desc(), F.col("run").desc(), "a", "b")
    )


def projection_similarity(
    records: DataFrame,
    rec: str = "rec",
    fields: str = "fields",
    min_fields: int = PROJECTION_MIN_FIELDS,
    min_sim: float = PROJECTION_MIN_SIMILARITY,
    top: int | None = None,
) -> DataFrame:
    """``a, b, shared, sim``: record pairs whose field-name sets have Jaccard >= ``min_sim``.

    All pairs of different sets, named by their smallest records, and each
    record with the smallest of its own set; with ``top`` a report of the
    strongest pairs of single records.

    Exact prefix-filter join. Equal sets are folded into one representative
    first, so a shape used by a third of all records is one row; within a set,
    fields are ordered rarest first, and two sets can only reach the threshold
    if they meet on one of the first ``size - ceil(sim * size) + 1`` fields.
    """
    sets = (
        records.select(F.col(rec).alias("rec"), F.sort_array(F.array_distinct(fields)).alias("fields"))
        .where(F.size("fields") >= min_fields)
    )
    shapes = sets.groupBy("fields").agg(F.min("rec").alias("shape"), F.count(F.lit(1)).alias("members"))
    flat = shapes.select("shape", F.size("fields").alias("n"), F.explode("fields").alias("field"))
    rarity = flat.groupBy("field").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        flat.join(rarity, "field")
        .groupBy("shape", "n")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "field"))), lambda s: s["field"]).alias("fields"))
    )
    keep = F.col("n") - F.ceil(F.lit(min_sim) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    prefix = ordered.select("shape", "n", F.explode(F.slice("fields", F.lit(1), keep)).alias("field"))
    left = prefix.select(F.col("shape").alias("a"), F.col("n").alias("na"), "field")
    right = prefix.select(F.col("shape").alias("b"), F.col("n").alias("nb"), "field")
    meet = left.join(right, "field").where(
        (F.col("a") < F.col("b"))
        & (F.col("na") >= F.col("nb") * min_sim - 1e-9)
        & (F.col("nb") >= F.col("na") * min_sim - 1e-9)
    )
    candidates = meet.select("a", "b").distinct()
    lookup = shapes.select(F.col("shape").alias("doc"), F.col("fields").alias("hashes"))
    both = with_sets(candidates, lookup, "hashes", "_fa", "_fb")
    shared = F.size(F.array_intersect("_fa", "_fb")).cast("bigint")
    scored = (
        both.withColumn("shared", shared)
        .withColumn("sim", F.col("shared") / (F.size("_fa") + F.size("_fb") - F.col("shared")))
        .where(F.col("sim") >= min_sim - 1e-12)
        .select("a", "b", "shared", "sim")
    )
    return expand_shapes(sets, shapes, scored, top)


def expand_shapes(sets: DataFrame, shapes: DataFrame, scored: DataFrame, top: int | None) -> DataFrame:
    """Shape pairs back to record pairs.

    With ``top`` only the strongest pairs are wanted, and no shape can
    contribute to them with more than its ``top + 1`` smallest members. Without
    it every record is paired with its shape's representative, which states
    equality without listing all pairs of a group.
    """
    members = sets.join(shapes.select("fields", "shape"), "fields").select("shape", "rec", F.size("fields").alias("n"))
    if top is None:
        same = members.where(F.col("rec") != F.col("shape")).select(
            F.col("shape").alias("a"), F.col("rec").alias("b"), F.col("n").cast("bigint").alias("shared"), F.lit(1.0).alias("sim")
        )
        return scored.unionByName(same)
    few = top_per_group(members, ["shape"], [F.col("rec").asc()], top + 1).select("shape", "rec", "n")
    x = few.select("shape", F.col("rec").alias("a"), F.col("n"))
    y = few.select("shape", F.col("rec").alias("b"))
    same = x.join(y, "shape").where(F.col("a") < F.col("b")).select(
        "a", "b", F.col("n").cast("bigint").alias("shared"), F.lit(1.0).alias("sim")
    )
    weakest = scored.orderBy(F.col("shared").desc(), F.col("sim").desc()).limit(top).agg(F.min(F.struct("shared", "sim")).alias("w"))
    strongest = scored.where(F.struct("shared", "sim") >= weakest.scalar())
    left = few.select(F.col("shape").alias("a"), F.col("rec").alias("ra"))
    right = few.select(F.col("shape").alias("b"), F.col("rec").alias("rb"))
    cross_shape = (
        strongest.join(left, "a")
        .join(right, "b")
        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "shared", "sim")
    )
    return (
        same.unionByName(cross_shape)
        .orderBy(F.col("shared").desc(), F.col("sim").desc(), "a", "b")
        .limit(top)
    )


def shared_token_pairs(docs: DataFrame, tokens: Column, doc: str = "doc_id", stop: list[str] | None = None) -> DataFrame:
    """``token, docs, first_doc, last_doc``: tokens found in two or more documents.

    The disjointness check expects no row. A shared token is reported once with
    its number of documents instead of once per pair of documents.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(tokens)).alias("token"))
    if stop:
        rows = rows.where(~F.col("token").isin(stop))
    return (
        rows.groupBy("token")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
        .where(F.col("docs") > 1)
    )


def pairwise_disjoint(docs: DataFrame, tokens: Column, doc: str = "doc_id", stop: list[str] | None = None) -> DataFrame:
    """``disjoint, shared_tokens`` in one row."""
    shared = shared_token_pairs(docs, tokens, doc, stop)
    return shared.agg(F.count(F.lit(1)).alias("shared_tokens")).select(
        (F.col("shared_tokens") == 0).alias("disjoint"), "shared_tokens"
    )


# Role suffixes that make two names peers.
ROLE_SUFFIXES = [
    "Handler", "Service", "Repository", "Aggregate", "Reducer", "Controller", "Resolver", "Command", "Query", "Job",
    "Processor", "Strategy", "Policy", "Event", "Listener", "Subscriber", "Publisher", "Exception", "Eligibility",
    "Ability", "QueryParam", "Specification", "Factory", "Builder",
]


def name_tokens(name: Column) -> Column:
    """Camel-case parts."""
    return tx.extract_tokens(name, r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", 0)


def peer_pairs(
    new: DataFrame, existing: DataFrame, name: str = "name", min_similarity: float = 0.6, roles: list[str] = ROLE_SUFFIXES
) -> DataFrame:
    """``new_name, peer_name, rule, role, peers``: candidate peers of each new name.

    Stem rule: the longest common run of camel-case parts, in characters, is at
    least ``min_similarity`` of the longer name. To qualify, the run must cover
    a part-aligned block, so names are blocked on whole token runs: each name
    emits its runs that are long enough for itself, and two names meet by an
    equi join on such a run. A shared role suffix makes a new name the peer of
    every existing name of that role; this is stated as one row per new name
    (``role`` and the number of ``peers``), whose members ``role_members`` lists.
    """
    new_names = new.select(F.col(name).alias("new_name")).distinct()
    peers = existing.select(F.col(name).alias("peer_name")).distinct().join(
        new_names.withColumnRenamed("new_name", "peer_name"), "peer_name", "left_anti"
    )

    def runs(frame: DataFrame, column: str) -> DataFrame:
        parts = name_tokens(F.col(column))
        spans = F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.array_join(F.slice(parts, i, n), "")
                ),
            )
        )
        long_enough = F.filter(F.array_distinct(spans), lambda s: F.length(s) >= F.length(F.col(column)) * min_similarity)
        return frame.where(F.size(parts) > 0).select(column, F.explode(long_enough).alias("run"))

    stem = (
        runs(new_names, "new_name")
        .join(runs(peers, "peer_name"), "run")
        .where(F.length("run") >= F.greatest(F.length("new_name"), F.length("peer_name")) * min_similarity)
        .select("new_name", "peer_name", F.lit("stem").alias("rule"))
    )
    variants = new_names.select(
        "new_name",
        F.explode(
            F.array(
                F.concat(F.lit("I"), "new_name"),
                F.regexp_replace("new_name", r"^I(?=[A-Z])", ""),
                F.concat("new_name", F.lit(".impl")),
                F.regexp_replace("new_name", r"\.impl$", ""),
                F.concat("new_name", F.lit("Abstract")),
                F.concat("new_name", F.lit("Base")),
                F.concat("new_name", F.lit("Protocol")),
                F.regexp_replace("new_name", r"(Abstract|Base|Protocol)$", ""),
            )
        ).alias("peer_name"),
    ).where(F.col("new_name") != F.col("peer_name"))
    interface = variants.distinct().join(peers, "peer_name", "left_semi").select(
        "new_name", "peer_name", F.lit("interface").alias("rule")
    )
    suffix = lambda c: F.regexp_extract(c, f"({'|'.join(sorted(roles, key=len, reverse=True))})$", 1)
    role_sizes = (
        peers.withColumn("role", suffix(F.col("peer_name")))
        .where(F.length("role") > 0)
        .groupBy("role")
        .agg(F.count(F.lit(1)).alias("peers"))
    )
    role = (
        new_names.withColumn("role", suffix(F.col("new_name")))
        .where(F.length("role") > 0)
        .join(F.broadcast(role_sizes), "role")  # one row per listed role
        .select("new_name", F.lit(None).cast("string").alias("peer_name"), F.lit("role").alias("rule"), "role", "peers")
    )
    named = stem.unionByName(interface).distinct()
    return named.select("*", F.lit(None).cast("string").alias("role"), F.lit(1).cast("bigint").alias("peers")).unionByName(role)


def role_members(names: DataFrame, name: str = "name", roles: list[str] = ROLE_SUFFIXES) -> DataFrame:
    """``role, name``: the members a role row of ``peer_pairs`` stands for."""
    pattern = f"({'|'.join(sorted(roles, key=len, reverse=True))})$"
    return (
        names.select(F.regexp_extract(name, pattern, 1).alias("role"), F.col(name).alias("name"))
        .where(F.length("role") > 0)
        .distinct()
    )
