"""Reference resolution: specifiers, citations, prefixes, dangling and dead names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions import text as tx
from plumbline.plans.skew import salted_join

# Alias prefixes mapped to folders, and the internal-specifier test.
ALIASES = {"@/": "", "@app/": "app/", "@lib/": "lib/"}
INTERNAL_RE = r"^(?:\.|~|@/|@app/|@lib/)"
MIN_REFS = 5
MIN_RATIO = 0.6


def specifier_base(src: Column, spec: Column) -> Column:
    """Path a specifier points at before extensions are tried; NULL for external ones."""
    out = F.when(
        spec.startswith("./") | spec.startswith("../"),
        paths.join_posix(F.when(F.instr(src, "/") > 0, paths.module_of(src)).otherwise(F.lit("")), spec),
    )
    for prefix, folder in ALIASES.items():
        out = out.when(spec.startswith(prefix), F.concat(F.lit(folder), F.substr(spec, F.lit(len(prefix) + 1))))
    return out


def resolve_reference(refs: DataFrame, universe: DataFrame, src: str = "src", spec: str = "spec", path: str = "path") -> DataFrame:
    """``src, spec, dst``: the first existing candidate of each specifier, NULL when external or missing.

    Every distinct (base) emits its ranked candidates (exact, extensions, index
    files) which meet the universe by an equi join.
    """
    based = refs.select(src, spec, specifier_base(F.col(src), F.col(spec)).alias("_base")).distinct()
    suffixes = [""] + [f".{e}" for e in paths.SCRIPT_EXT] + [f"/index.{e}" for e in paths.SCRIPT_EXT]
    bases = based.where(F.col("_base").isNotNull()).select("_base").distinct()
    tries = bases.select(
        "_base",
        F.posexplode(F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.concat(F.col("_base"), s))).alias(
            "rank", path
        ),
    )
    found = (
        tries.join(universe.select(path).distinct(), path)
        .groupBy("_base")
        .agg(F.min_by(path, "rank").alias("dst"))
    )
    return based.join(found, "_base", "left").select(src, spec, "dst")


def import_edges(resolved: DataFrame) -> DataFrame:
    """``src, dst``: resolved references without self references."""
    return resolved.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select("src", "dst").distinct()


def resolve_path(cites: DataFrame, universe: DataFrame, tok: str = "tok", path: str = "path") -> DataFrame:
    """``tok, resolved, reason``: exact path, else unique suffix match, else NULL with the reason.

    Every path emits its suffixes (as many as it has segments); suffixes meet
    the distinct tokens by an equi join, so nothing is scanned per token.
    """
    norm = F.regexp_replace(paths.to_posix(F.col(tok)), r"^\./", "")
    wanted = cites.select(F.col(tok), norm.alias("_norm")).distinct()
    keys = wanted.select("_norm").distinct()
    tails = universe.select(F.col(path), F.explode(paths.suffixes(F.col(path))).alias("_norm"))
    matched = (
        salted_join(tails, keys, ["_norm"], spread_by=[F.col(path)])
        .groupBy("_norm")
        .agg(
            F.max(F.when(F.col(path) == F.col("_norm"), F.col(path))).alias("exact"),
            F.sum((F.col(path) != F.col("_norm")).cast("bigint")).alias("hits"),
            F.min(F.when(F.col(path) != F.col("_norm"), F.col(path))).alias("one"),
        )
    )
    return wanted.join(matched, "_norm", "left").select(
        tok,
        F.coalesce("exact", F.when(F.col("hits") == 1, F.col("one"))).alias("resolved"),
        F.when(F.col("exact").isNotNull() | (F.col("hits") == 1), F.lit(None))
        .when(F.col("hits") > 1, F.concat(F.lit("ambiguous: "), F.col("hits").cast("string"), F.lit(" matches")))
        .otherwise(F.lit("no such file"))
        .alias("reason"),
    )


def ambiguous_names(cites: DataFrame, universe: DataFrame, tok: str = "tok", path: str = "path") -> DataFrame:
    """``tok, files``: bare base names that several documents carry."""
    names = universe.groupBy(paths.base_of(F.col(path)).alias(tok)).agg(F.count(F.lit(1)).alias("files"))
    bare = cites.where(~F.col(tok).contains("/") & ~F.col(tok).contains("\\")).select(tok).distinct()
    return bare.join(names.where(F.col("files") >= 2), tok)


def lookup_near_path(cites: DataFrame, universe: DataFrame, tok: str = "tok", path: str = "path") -> DataFrame:
    """``tok, resolved, how``: the looser resolver.

    Order: exact, unique suffix, unique base name, unique base name with the
    token's folder fragment, else the first suffix or base-name hit.
    """
    parent = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", ""))
    wanted = cites.select(F.col(tok)).distinct()
    wanted = wanted.select(tok, paths.base_of(F.col(tok)).alias("_base"), parent(F.col(tok)).alias("_frag"))
    files = universe.select(F.col(path), paths.base_of(F.col(path)).alias("_base"))
    named = files.groupBy("_base").agg(F.count(F.lit(1)).alias("n_base"), F.min(path).alias("base"))
    # Exact and suffix matches: path tails meet tokens by an equi join.
    tails = files.select(F.col(path), F.explode(paths.suffixes(F.col(path))).alias(tok))
    proper = F.col(path) != F.col(tok)
    tailed = (
        salted_join(tails, wanted.select(tok), [tok], spread_by=[F.col(path)])
        .groupBy(tok)
        .agg(
            F.max(F.when(~proper, F.col(path))).alias("exact"),
            F.count(F.when(proper, 1)).alias("n_tail"),
            F.min(F.when(proper, F.col(path))).alias("tail"),
        )
    )
    known = wanted.join(named, "_base").join(tailed, tok, "left").withColumn("n_tail", F.coalesce("n_tail", F.lit(0)))
    # Only names still open after that are compared by folder fragment, again by an equi join.
    unclear = known.where(F.col("exact").isNull() & (F.col("n_tail") != 1) & (F.col("n_base") > 1) & F.col("_frag").isNotNull())
    asked = unclear.select(tok, "_base", "_frag")
    near = files.join(asked.select("_base").distinct(), "_base", "left_semi").select(
        path, "_base", F.explode(folder_fragments(parent(F.col(path)))).alias("_frag")
    )
    framed = (
        salted_join(near, asked, ["_base", "_frag"], spread_by=[F.col(path)])
        .groupBy(tok)
        .agg(F.count(F.lit(1)).alias("n_framed"), F.min(path).alias("framed"))
    )
    how = (
        F.when(F.col("exact").isNotNull(), "exact")
        .when(F.col("n_tail") == 1, "suffix")
        .when(F.col("n_base") == 1, "name")
        .when(F.col("n_framed") == 1, "name+folder")
        .when(F.col("n_base") > 1, "first")
    )
    pick = (
        F.when(F.col("how") == "exact", F.col("exact"))
        .when(F.col("how") == "suffix", F.col("tail"))
        .when(F.col("how") == "name", F.col("base"))
        .when(F.col("how") == "name+folder", F.col("framed"))
        .when(F.col("how") == "first", F.coalesce("tail", "base"))
    )
    found = known.join(framed, tok, "left").withColumn("how", how).select(tok, pick.alias("resolved"), "how")
    return wanted.select(tok).join(found, tok, "left")


def folder_fragments(folder: Column) -> Column:
    """Every text ``f`` for which ``f/`` occurs in ``folder/``, starting inside one segment and ending at a segment end."""
    segments = F.split(folder, "/")
    runs = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda i: F.transform(
            F.sequence(i, F.size(segments)),
            lambda j: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(F.element_at(segments, i)), F.lit(1))),
                lambda c: F.array_join(
                    F.concat(F.array(F.substr(F.element_at(segments, i), c)), F.slice(segments, i + 1, j - i)), "/"
                ),
            ),
        ),
    )
    return F.array_distinct(F.flatten(F.flatten(runs)))


def longest_prefix_map(
    items: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix", owner: str = "owner"
) -> DataFrame:
    """Adds ``owner, prefix``: the owner of the longest path-boundary prefix of each path (NULL if none).

    Paths are reduced to their distinct values, each emits its ancestors, and
    the ancestors meet the prefixes by an equi join. A prefix that cites one
    document with a line suffix matches that document.
    """
    owned = prefixes.select(F.regexp_replace(prefix, r"(\.[^:]*):\d+.*$", "$1").alias("prefix"), F.col(owner).alias("owner"))
    one_owner = owned.groupBy("prefix").agg(F.min("owner").alias("owner"))
    distinct_paths = items.select(F.col(path).alias("_path")).distinct()
    up = distinct_paths.select("_path", F.explode(paths.ancestors(F.col("_path"))).alias("prefix"))
    best = (
        salted_join(up, one_owner, ["prefix"], spread_by=[F.col("_path")])
        .groupBy("_path")
        .agg(F.max_by(F.struct("owner", "prefix"), F.length("prefix")).alias("_best"))
    )
    return items.join(best, items[path] == best["_path"], "left").select(
        *[items[c] for c in items.columns], F.col("_best.owner").alias(owner), F.col("_best.prefix").alias(prefix)
    )


def dangling(refs: DataFrame, defs: DataFrame, ref: str = "name", name: str = "name") -> DataFrame:
    """References without a definition."""
    return refs.join(defs.select(F.col(name).alias(ref)).distinct(), ref, "left_anti")


def orphans(defs: DataFrame, refs: DataFrame, name: str = "name", ref: str = "name") -> DataFrame:
    """Definitions never referenced."""
    return defs.join(refs.select(F.col(ref).alias(name)).distinct(), name, "left_anti")


def reference_tokens(docs: DataFrame, pattern: str, doc: str = "doc_id", text: str = "text", ignore: str | None = None) -> DataFrame:
    """``doc, name``: referenced names per line; marked lines are skipped and a ``plugin:`` prefix is stripped."""
    kept = tx.lines(F.col(text))
    if ignore:
        kept = F.filter(kept, lambda l: ~F.contains(l, F.lit(ignore)))
    found = F.flatten(F.transform(kept, lambda l: F.regexp_extract_all(l, F.lit(pattern), F.lit(1))))
    return docs.select(doc, F.explode(found).alias("raw")).select(
        doc, F.element_at(F.split("raw", ":"), -1).alias("name")
    )


def dead_definitions(
    defs: DataFrame, refs: DataFrame, doc: str = "doc", name: str = "name", kind: str | None = None, behavioural: Sequence[str] = ()
) -> DataFrame:
    """Definitions without a reference outside their own document.

    References are reduced to, per name, the number of documents and one of
    them; a name referenced by exactly one document is dead only there.
    """
    users = refs.select(F.col(name), F.col(doc)).distinct().groupBy(name).agg(
        F.count(F.lit(1)).alias("_docs"), F.min(doc).alias("_only")
    )
    dead = defs.join(users, name, "left").where(
        F.col("_docs").isNull() | ((F.col("_docs") == 1) & (F.col("_only") == F.col(doc)))
    )
    out = dead.drop("_docs", "_only")
    if kind is not None:
        out = out.withColumn("rank", F.when(F.col(kind).isin(list(behavioural)), F.lit(0)).otherwise(F.lit(1)))
    return out


def unreferenced_modules(modules: DataFrame, edges: DataFrame, entry_points: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Modules nothing points at, entry points aside."""
    out = modules.join(edges.select(F.col("dst").alias(path)).distinct(), path, "left_anti")
    if entry_points is not None:
        out = out.join(entry_points.select(path).distinct(), path, "left_anti")
    return out


def behavioural_refs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, name, refs``: names used as a call or member access, counted per document."""
    names = tx.extract_tokens(F.col(text), r"(?<![\w$])([A-Za-z_$][\w$]*)(?=\s*[.(])", 1)
    return docs.select(F.col(doc).alias("doc"), F.explode(names).alias("name")).groupBy("doc", "name").agg(
        F.count(F.lit(1)).alias("refs")
    )


def envy(
    refs: DataFrame,
    bindings: DataFrame,
    own: DataFrame,
    targets: DataFrame | None = None,
    min_refs: int = MIN_REFS,
    min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """``doc, module, ext, own, ratio``: documents that lean on one internal module.

    ``refs(doc, name, refs)`` holds behavioural reference counts,
    ``bindings(doc, module, name, internal)`` the imported names,
    ``own(doc, name)`` a document's symbols and ``targets(doc, module, behavioral)``
    the behavioural symbol count of resolved modules (missing row: unresolved,
    kept; zero: data only, dropped).
    """
    outside = (
        bindings.where("internal")
        .join(refs, ["doc", "name"], "left")
        .groupBy("doc", "module")
        .agg(F.sum(F.coalesce("refs", F.lit(0))).alias("ext"))
    )
    best = outside.groupBy("doc").agg(F.max_by(F.struct("module", "ext"), F.struct("ext", "module")).alias("b"))
    inside = own.join(refs, ["doc", "name"]).groupBy("doc").agg(F.sum("refs").alias("own"))
    scored = (
        best.select("doc", "b.module", "b.ext")
        .join(inside, "doc", "left")
        .withColumn("own", F.coalesce("own", F.lit(0)))
        .withColumn("ratio", F.col("ext") / F.greatest(F.col("ext") + F.col("own"), F.lit(1)))
        .where((F.col("ext") >= min_refs) & (F.col("ratio") >= min_ratio))
    )
    if targets is None:
        return scored
    return (
        scored.join(targets, ["doc", "module"], "left")
        .where(F.col("behavioral").isNull() | (F.col("behavioral") > 0))
        .drop("behavioral")
    )


# Import statement patterns of the binding extractor.
ESM_RE = r"import\s+([^'\";]+?)\s+from\s*['\"]([^'\"]+)['\"]"
REQUIRE_RE = r"(?:const|let|var)\s+(\{[^}]*\}|[A-Za-z_$][\w$]*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"


def import_bindings(docs: DataFrame, doc: str = "path", text: str = "text") -> DataFrame:
    """``doc, module, name, internal``: local names bound by imports; type-only imports bind nothing."""
    def matches(pattern: str) -> DataFrame:
        found = docs.select(F.col(doc).alias("doc"), F.explode(tx.extract_tokens(F.col(text), pattern, 0)).alias("s"))
        return found.select(
            "doc",
            F.trim(F.regexp_extract("s", pattern, 1)).alias("clause"),
            F.regexp_extract("s", pattern, 2).alias("module"),
        )

    clauses = matches(ESM_RE).unionByName(matches(REQUIRE_RE)).where(~F.col("clause").rlike(r"^type(\s|$)"))
    clause = F.regexp_replace("clause", r"(?<![\w])type\s+", "")
    braces = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
    parts = F.filter(F.transform(F.split(braces, ","), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    named = F.transform(
        parts,
        lambda p: F.when(p.rlike(r"(?<![\w])as\s+"), F.regexp_extract(p, r"(?<![\w])as\s+([A-Za-z_$][\w$]*)", 1)).otherwise(
            F.element_at(F.split(p, r"\s+"), 1)
        ),
    )
    names = F.filter(
        F.concat(
            F.array(
                F.regexp_extract(clause, r"\*\s+as\s+([A-Za-z_$][\w$]*)", 1),
                F.regexp_extract(clause, r"^([A-Za-z_$][\w$]*)\s*(?:,|$)", 1),
            ),
            named,
        ),
        lambda n: F.length(n) > 0,
    )
    return clauses.select(
        "doc", "module", F.explode(names).alias("name"), F.col("module").rlike(INTERNAL_RE).alias("internal")
    )
