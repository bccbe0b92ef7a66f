"""Corpus profiling: sizes, markers, categories, ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.records import round_half_up
from plumbline.plans.lineage import materialize
from plumbline.plans.skew import salted_join

# Absolute size limits for a corpus with one document, by language.
SINGLE_DOC_LIMITS = {"ts": 200, "rs": 200, "go": 200, "py": 300, "kt": 300, "cs": 400, "java": 500}
SINGLE_DOC_DEFAULT = 200

# Concern categories of imported modules; every matching rule counts.
CONCERN_RULES = [
    ("persistence", r"(?i)(?:^|[/@.-])(?:db|database|sql|sqlite|postgres|mysql|mongo|mongoose|redis|ioredis|prisma|supabase|sequelize|knex|typeorm|drizzle|dynamodb|repositor)"),
    ("network", r"(?i)(?:^|[/@.-])(?:axios|node-fetch|undici|got|ky|superagent|graphql-request|api-client|http-client|xmlhttp)"),
    ("ui", r"(?i)(?:^|[/@.-])(?:react|react-dom|preact|vue|svelte|solid-js|angular|next\/|styled-components|emotion|tailwind|components?|\.css|\.scss|\.module)"),
    ("validation", r"(?i)(?:^|[/@.-])(?:zod|yup|joi|ajv|superstruct|valibot|class-validator|validator|schema-?validat)"),
    ("auth", r"(?i)(?:^|[/@.-])(?:bcrypt|bcryptjs|argon2|scrypt|jsonwebtoken|jose|jwt|passport|oauth|next-auth|crypto|session)"),
    ("fs-io", r"(?i)(?:^|[/@.-])(?:node:fs|node:child_process|fs-extra|graceful-fs|chokidar|rimraf|mkdirp)|^fs$|^glob$"),
    ("logging", r"(?i)(?:^|[/@.-])(?:winston|pino|bunyan|log4js|loglevel|sentry|datadog|opentelemetry|logger|debug)"),
    ("config-env", r"(?i)(?:^|[/@.-])(?:dotenv|env-var|convict|cosmiconfig)|(?:^|[/@.-])config$"),
    ("serialization", r"(?i)(?:^|[/@.-])(?:js-yaml|yaml|xml2js|fast-xml|papaparse|csv-parse|csv-stringify|protobufjs|msgpack|marked|remark|cheerio|parser)"),
    ("messaging", r"(?i)(?:^|[/@.-])(?:amqplib|kafkajs|bullmq|bull|nats|mqtt|rabbitmq|pubsub|sqs|kinesis)"),
]

# Import specifier patterns.
SPECIFIER_RES = [
    r"(?<![A-Za-z0-9_])from\s*['\"]([^'\"]+)['\"]",
    r"(?<![A-Za-z0-9_])import\s*['\"]([^'\"]+)['\"]",
    r"(?<![A-Za-z0-9_])require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?<![A-Za-z0-9_])import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
]

# Empty or comment-only handlers, exported declarations, test markers.
EMPTY_CATCH_RE = r"(?<![A-Za-z0-9_])catch(?![A-Za-z0-9_])\s*(?:\([^)]*\))?\s*\{(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*\}"
EMPTY_PROMISE_CATCH_RE = (
    r"\.catch\s*\(\s*(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>\s*\{\s*\}\s*\)"
    r"|\.catch\s*\(\s*function\s*\([^)]*\)\s*\{\s*\}\s*\)"
)
EXPORT_RE = (
    r"(?m)^\s*export\s+(?:default\s+|async\s+)?(?:const|let|var|function|class|interface|type|enum|abstract\s+class)"
    r"(?![A-Za-z0-9_])|^\s*export\s*\{"
)
TEST_CASE_RE = r"(?<![A-Za-z0-9_])(?:it|test)\s*\("
ASSERT_RE = (
    r"(?<![A-Za-z0-9_])(?:expect|assert)\s*\("
    r"|\.(?:toBe|toEqual|toMatch|toThrow|toHaveBeenCalled)(?![A-Za-z0-9_])"
)

# Table markers, write calls and remote calls in source text.
FROM_LITERAL_RE = r"\.from\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)"
FROM_NAME_RE = r"\.from\s*\(\s*([A-Za-z_$][\w$]*)\s*\)"
CONST_STRING_RE = r"(?<![A-Za-z0-9_])const\s+([A-Za-z_$][\w$]*)\s*=\s*[\"'`]([^\"'`]+)[\"'`]"
WRITE_CALL_RE = r"\.(?:insert|update|upsert|delete)\s*\("
REMOTE_CALL_RE = r"\.rpc\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"


def size_profile(docs: DataFrame, size: str = "loc") -> DataFrame:
    """``file_count, loc_total, loc_median, loc_p90`` in one row.

    Sizes are counted per distinct value first; the exact percentile then works
    on the histogram, whose length is bounded by the largest document.
    """
    hist = docs.where(F.col(size).isNotNull()).groupBy(F.col(size).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return hist.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"),
        F.coalesce(F.sum(F.col("v") * F.col("n")), F.lit(0)).cast("bigint").alias("loc_total"),
        F.coalesce(round_half_up(F.expr("percentile(v, 0.5, n)")), F.lit(0)).alias("loc_median"),
        F.coalesce(round_half_up(F.expr("percentile(v, 0.9, n)")), F.lit(0)).alias("loc_p90"),
    )


def size_threshold(profile: DataFrame) -> DataFrame:
    """Adds ``median`` (0 counts as 1) and ``threshold = max(3 * median, round(1.5 * p90))``."""
    median = F.when(F.col("loc_median") == 0, F.lit(1)).otherwise(F.col("loc_median"))
    return profile.withColumn("median", median.cast("bigint")).withColumn(
        "threshold", F.greatest(3 * F.col("median"), round_half_up(1.5 * F.col("loc_p90")))
    )


def size_outliers(docs: DataFrame, size: str = "loc", language: str | None = None) -> DataFrame:
    """Documents above the corpus threshold, with ``ratio = size / median``.

    A corpus with a single document has no peers: there the absolute limit of
    its language decides (when ``language`` names the column).
    """
    limits = size_threshold(size_profile(docs, size))
    threshold = limits.select("threshold").scalar()
    median = limits.select("median").scalar()
    over = F.col(size) > threshold
    if language is not None:
        absolute = F.coalesce(
            F.try_element_at(
                F.create_map(*[F.lit(x) for kv in SINGLE_DOC_LIMITS.items() for x in kv]), F.col(language)
            ),
            F.lit(SINGLE_DOC_DEFAULT),
        )
        over = F.when(limits.select("file_count").scalar() == 1, F.col(size) > absolute).otherwise(over)
    return docs.where(over).withColumn("ratio", F.round(F.col(size) / median, 1))


def marker_count(docs: DataFrame, patterns: Sequence[str], text: str = "text", out: str = "markers") -> DataFrame:
    """Documents with at least one marker."""
    total = sum((tx.count_matches(F.col(text), p) for p in patterns), F.lit(0).cast("bigint"))
    return docs.withColumn(out, total).where(F.col(out) > 0)


def marker_density(docs: DataFrame, a_re: str, b_re: str, text: str = "text", below: float = 1.0) -> DataFrame:
    """Documents with marker ``a`` where ``b / a`` stays under ``below``."""
    counted = docs.withColumn("a", tx.count_matches(F.col(text), a_re)).withColumn(
        "b", tx.count_matches(F.col(text), b_re)
    )
    return counted.where(F.col("a") > 0).withColumn("ratio", F.col("b") / F.col("a")).where(F.col("ratio") < below)


def specifiers(text: Column) -> Column:
    return F.array_distinct(F.concat(*[tx.extract_tokens(text, r, 1) for r in SPECIFIER_RES]))


def categories(tokens: Column, rules: Sequence[tuple[str, str]] = CONCERN_RULES) -> Column:
    """Distinct categories hit by any token; all matching rules count.

    Rules are evaluated inside the row: no explode, no join, no shuffle.
    """

    def hit(name: str, pattern: str) -> Column:
        return F.when(F.exists(tokens, lambda t: t.rlike(pattern)), F.lit(name))

    hits = [hit(name, pattern) for name, pattern in rules]
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*hits))))


def categorize(
    docs: DataFrame, tokens: Column, rules: Sequence[tuple[str, str]] = CONCERN_RULES, out: str = "cats"
) -> DataFrame:
    return docs.withColumn("categories", categories(tokens, rules)).withColumn(out, F.size("categories").cast("bigint"))


def write_ownership(events: DataFrame, entity: str, writer: str, min_writers: int = 1) -> DataFrame:
    """``entity, writers, scattered``: distinct writers per entity; two or more are scattered.

    The distinct (entity, writer) pairs are formed first, so an entity written
    millions of times by few writers costs few rows.
    """
    pairs = events.select(entity, writer).distinct()
    return (
        pairs.groupBy(entity)
        .agg(F.count(F.lit(1)).alias("writers"))
        .where(F.col("writers") >= min_writers)
        .withColumn("scattered", F.col("writers") >= 2)
    )


def ownership_members(events: DataFrame, entity: str, writer: str, min_writers: int = 2) -> DataFrame:
    """``entity, writer``: the writers of every entity with enough of them, as rows.

    Rows instead of one list per entity, so an entity written from everywhere
    does not end up in one value.
    """
    pairs = events.select(entity, writer).distinct()
    wanted = write_ownership(events, entity, writer, min_writers).select(entity)
    return salted_join(pairs, wanted, [entity], "left_semi", spread_by=[F.col(writer)])


def nearest_preceding(
    markers: DataFrame, calls: DataFrame, key: Sequence[str], pos: str, label: str, max_gap: int = 400
) -> DataFrame:
    """Attribute each call to the closest earlier marker of its key within ``max_gap`` (exclusive).

    Of markers at one position the last in order of their labels counts. An as-of join over ranges: rows are dealt to
    tasks by key and position, so a key with most of the rows lies in many ranges, and a call sees the markers of its
    own range and the last one of its key in the ranges before, which a scan over one row per range and key hands on.
    """
    key = list(key)
    m = markers.select(*key, F.col(pos), F.col(label), F.lit(0).alias("_call"))
    # A call may carry further columns; they travel in one struct.
    extra = [c for c in calls.columns if c not in {*key, pos}]
    c = calls.select(*key, F.col(pos), F.lit(1).alias("_call"), F.struct(F.lit(1), *extra).alias("_row"))
    both = m.unionByName(c, allowMissingColumns=True).withColumn("_tie", F.xxhash64("_row"))
    # A call sorts before a marker at the same position: only earlier markers count.
    order = [F.col(pos), F.col("_call").desc(), F.col(label)]
    ranged = both.repartitionByRange(*key, *order, "_tie").withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged.drop("_tie"), "ranges")
    marker = F.when(F.col("_call") == 0, F.struct(F.col(pos).alias("at"), F.col(label).alias("label")))
    unbounded = Window.unboundedPreceding
    lasts = ranged.groupBy("_range", *key).agg(F.max(marker).alias("_last"))
    handed = F.last("_last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_range").rowsBetween(unbounded, -1))
    handed = lasts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], handed.alias("_before"))
    handed = handed.where("_before IS NOT NULL")
    earlier = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(unbounded, -1)
    matched = ranged.withColumn("_m", F.last(marker, ignorenulls=True).over(earlier)).where(F.col("_call") == 1)
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    matched = matched.join(handed, same, "left").withColumn("_m", F.coalesce("_m", "_before"))
    near = F.col(pos) - F.col("_m.at") < max_gap
    return matched.select(
        *key, pos, *[F.col(f"_row.{e}").alias(e) for e in extra], F.when(near, F.col("_m.label")).alias(label)
    )


def write_sites(docs: DataFrame, path: str = "path", text: str = "text", max_gap: int = 400) -> DataFrame:
    """``path, site`` rows: every write call with its table, and every remote-call name.

    Table names given as a constant of the same document are resolved; an
    unresolved constant keeps its own name.
    """
    matches = lambda pattern: _positions(F.col(text), pattern)
    base = docs.select(path, text)
    constants = base.select(
        path,
        F.explode(
            F.transform(
                tx.extract_tokens(F.col(text), CONST_STRING_RE, 0),
                lambda s: F.struct(
                    F.regexp_extract(s, CONST_STRING_RE, 1).alias("name"),
                    F.regexp_extract(s, CONST_STRING_RE, 2).alias("value"),
                ),
            )
        ).alias("k"),
    ).select(path, "k.name", "k.value")
    named = base.select(path, F.explode(matches(FROM_NAME_RE)).alias("m")).select(
        path, F.col("m.pos").alias("pos"), F.regexp_extract("m.token", FROM_NAME_RE, 1).alias("name")
    )
    resolved = named.join(constants, [path, "name"], "left").select(
        path, "pos", F.coalesce("value", "name").alias("site")
    )
    literal = base.select(path, F.explode(matches(FROM_LITERAL_RE)).alias("m")).select(
        path, F.col("m.pos").alias("pos"), F.regexp_extract("m.token", FROM_LITERAL_RE, 1).alias("site")
    )
    calls = base.select(path, F.explode(matches(WRITE_CALL_RE)).alias("m")).select(path, F.col("m.pos").alias("pos"))
    tables = (
        nearest_preceding(literal.unionByName(resolved), calls, [path], "pos", "site", max_gap)
        .where(F.col("site").isNotNull())
        .select(path, F.concat(F.lit("table:"), F.col("site")).alias("site"))
    )
    remote = base.select(path, F.explode(tx.extract_tokens(F.col(text), REMOTE_CALL_RE, 1)).alias("name")).select(
        path, F.concat(F.lit("rpc:"), F.col("name")).alias("site")
    )
    return tables.unionByName(remote).distinct()


def _positions(text: Column, pattern: str) -> Column:
    """``array<struct<pos, token>>`` of all matches.

    The pieces between matches come from ``split``; piece and match lengths add
    up to the offset of every match.
    """
    tokens = tx.extract_tokens(text, pattern, 0)
    pieces = F.split(text, pattern)
    offsets = F.aggregate(
        F.zip_with(pieces, tokens, lambda p, t: F.struct(F.length(p).alias("p"), t.alias("t"))),
        F.struct(
            F.lit(0).alias("at"), F.expr("cast(array() as array<struct<pos: int, token: string>>)").alias("out")
        ),
        lambda acc, x: F.when(
            x["t"].isNotNull(),
            F.struct(
                (acc["at"] + x["p"] + F.length(x["t"])).alias("at"),
                F.concat(
                    acc["out"], F.array(F.struct((acc["at"] + x["p"]).alias("pos"), x["t"].alias("token")))
                ).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    return offsets


def usage(
    docs: DataFrame,
    declarations: Column,
    stem: Column,
    tokens: Column,
    doc: str = "doc_id",
    min_declarations: int = 5,
) -> DataFrame:
    """``doc, declared, stem, inbound``: how many OTHER documents mention a document's stem.

    Every document with enough declarations is reported. A NULL stem (generic
    name) has unknown inbound. The join runs on distinct (token, doc) pairs
    restricted to wanted stems; counts are reduced per token before they meet
    the documents.
    """
    base = docs.select(F.col(doc), declarations.alias("declared"), stem.alias("stem"))
    wanted = base.where(F.col("declared") >= min_declarations)
    stems = wanted.where(F.col("stem").isNotNull()).select("stem").distinct()
    mentions = docs.select(F.col(doc), F.explode(F.array_distinct(tokens)).alias("stem"))
    mentioned = mentions.join(stems, "stem")
    per_stem = mentioned.groupBy("stem").agg(F.count(F.lit(1)).alias("docs"))
    own = mentioned.select(F.col(doc), "stem", F.lit(1).alias("self"))
    return (
        wanted.join(per_stem, "stem", "left")
        .join(own, [doc, "stem"], "left")
        .withColumn(
            "inbound",
            F.when(
                F.col("stem").isNotNull(), F.coalesce("docs", F.lit(0)) - F.coalesce("self", F.lit(0))
            ).cast("bigint"),
        )
        .select(doc, "declared", "stem", "inbound")
    )


def usage_by_text(
    docs: DataFrame, candidates: DataFrame, doc: str = "doc_id", text: str = "text", stem: str = "stem", seed: int = 3
) -> DataFrame:
    """Substring variant of ``usage``: adds ``inbound``, the number of other documents that contain the stem anywhere.

    A stem holds no white space and lies inside a run of characters that occur in stems, so texts are cut at all others
    (non-ASCII ones count as one). Each distinct run long enough for a stem is cut at every position into seeds of at
    most ``seed`` characters, of the lengths that the stems' have; stems meet runs on their first characters and are
    then compared as a whole, so the number of stems is free.
    """
    stems = materialize(candidates.where(F.length(stem) > 0).select(F.col(stem).alias("_stem")).distinct(), "stems")
    size = F.least(F.length("_stem"), F.lit(seed))
    keyed = stems.withColumn("_seed", F.substring("_stem", 1, seed))
    # At most 128 characters and ``seed`` lengths.
    held = stems.select(F.explode(F.array_distinct(F.transform(F.split("_stem", ""), lambda c: F.least(F.ascii(c), F.lit(128))))).alias("c")).distinct()
    codes = sorted(r["c"] for r in held.collect())
    lengths = sorted(r["n"] for r in stems.select(size.alias("n")).distinct().collect()) or [seed]
    inside = "".join(rf"\x{{{c:x}}}" if c < 128 else r"\x{80}-\x{10FFFF}" for c in codes if c > 127 or not chr(c) in " \t\n\v\f\r")
    apart = rf"[^{inside}]+" if inside else r"[\s\S]+"
    cut = F.filter(F.array_distinct(F.split(text, apart)), lambda r: F.length(r) >= lengths[0])
    words = docs.select(F.col(doc).alias("_hit"), F.explode(cut).alias("_run"))
    runs = words.select("_run").distinct()
    sizes = F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("_run")))
    places = runs.select("_run", sizes.alias("_n")).select("_run", "_n", F.explode(F.expr("sequence(1, length(_run) - _n + 1)")).alias("_at"))
    cuts = places.select("_run", "_at", F.expr("substring(_run, _at, _n)").alias("_seed"))
    found = cuts.join(keyed, "_seed").where(F.expr("substring(_run, _at, length(_stem)) = _stem")).select("_run", "_stem").distinct()
    # Stored, as it is counted and looked up.
    hits = materialize(words.join(found, "_run").select("_hit", "_stem").distinct(), "hits")
    per_stem = hits.groupBy("_stem").agg(F.count(F.lit(1)).alias("_docs"))
    own = hits.select(F.col("_hit").alias(doc), F.col("_stem").alias(stem), F.lit(1).alias("_self"))
    joined = candidates.join(per_stem.withColumnRenamed("_stem", stem), stem, "left").join(own, [doc, stem], "left")
    inbound = F.coalesce("_docs", F.lit(0)) - F.coalesce("_self", F.lit(0))
    return joined.select(*candidates.columns, F.when(F.col(stem).isNotNull(), inbound).cast("bigint").alias("inbound"))


def god_docs(
    docs: DataFrame,
    size: str = "loc",
    cats: str = "cats",
    cohesion: str = "cohesion",
    min_cats: int = 4,
    low: float = 0.4,
) -> DataFrame:
    """Documents flagged for mixing at any size, or for size with low or unmeasured cohesion."""
    limits = size_threshold(size_profile(docs, size))
    threshold = limits.select("threshold").scalar()
    median = limits.select("median").scalar()
    large = F.col(size) > threshold
    mixing = F.coalesce(F.col(cats), F.lit(0)) >= min_cats
    weak = F.col(cohesion).isNull() | (F.col(cohesion) < low)
    reason = (
        F.when(mixing & large & weak, "mixing+size")
        .when(mixing, "mixing")
        .when(large & weak & F.col(cohesion).isNull(), "size")
        .when(large & weak, "size+low-cohesion")
    )
    return (
        docs.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .withColumn("ratio", F.round(F.col(size) / median, 1))
    )


def low_cohesion(docs: DataFrame, flagged: DataFrame, doc: str = "doc_id", low: float = 0.4, min_behavioral: int = 6) -> DataFrame:
    """Documents under the cohesion limit with enough behavioural symbols, minus the flagged ones."""
    return docs.where((F.col("cohesion") < low) & (F.col("behavioral") >= min_behavioral)).join(
        flagged.select(doc), doc, "left_anti"
    )


def unpaired(tokens: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur fewer than two times."""
    return tokens.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < 2)


def shape_conflicts(decls: DataFrame, name: str = "name", fields: str = "fields", min_fields: int = 3) -> DataFrame:
    """``kind, label, defs, variants``.

    *drift*: one name with several signatures; *same-shape*: one signature with
    several names. Declarations are pre-counted per (name, signature).
    """
    signed = decls.where(F.size(fields) >= min_fields).select(
        F.col(name).alias("name"), F.array_join(F.sort_array(fields), ";").alias("sig")
    )
    counted = signed.groupBy("name", "sig").agg(F.count(F.lit(1)).alias("n"))
    variant = lambda kind, key: (
        counted.groupBy(F.col(key).alias("label"))
        .agg(F.sum("n").alias("defs"), F.count(F.lit(1)).alias("variants"))
        .where(F.col("variants") > 1)
        .select(F.lit(kind).alias("kind"), "label", "defs", "variants")
    )
    return variant("drift", "name").unionByName(variant("same-shape", "sig"))


def prefix_cluster(paths_df: DataFrame, path: str = "path", min_members: int = 2) -> DataFrame:
    """``path, cluster, members``: the longest folder prefix shared by enough items; singletons stand alone.

    Every item emits its ancestor folders (as many as it has levels); counts per
    prefix combine map-side, and each item keeps its deepest shared one.
    """
    parts = F.split(F.col(path), "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    up = paths_df.select(
        path, F.posexplode(F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>"))).alias("depth", "prefix")
    )
    shared = up.groupBy("prefix").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= min_members)
    best = up.join(shared, "prefix").groupBy(path).agg(
        F.max_by(F.struct("prefix", "members"), F.col("depth")).alias("b")
    )
    return paths_df.join(best, path, "left").select(
        *[F.col(c) for c in paths_df.columns],
        F.coalesce("b.prefix", F.col(path)).alias("cluster"),
        F.coalesce("b.members", F.lit(1)).alias("members"),
    )
