"""Path expressions on POSIX-style path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions read as source text.
SOURCE_EXT = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "cts", "mts", "py", "go", "rs", "java", "kt", "cs", "rb", "php",
              "swift", "scala"]
SCRIPT_EXT = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "cts", "mts"]

# Stems too generic to search for.
STOP_STEMS = [
    "index", "types", "type", "utils", "util", "helpers", "helper", "constants", "const", "lib", "src", "main", "core",
    "common", "shared", "base", "config", "test", "tests", "spec", "mod", "init", "app", "api", "client", "server",
]

# Test, declaration and generated file names.
TEST_NAME_RE = r"(?i)\.(test|spec)\.[a-z]+$"
TEST_DIR_RE = r"(^|/)__tests__/"
DECLARATION_RE = r"(?i)\.d\.ts$"
GENERATED_RES = [
    r"(?i)\.(?:gen|generated)\.[a-z0-9]+$",
    r"(?i)(?:^|[._-])pb2?\.[a-z0-9]+$",
    r"(?i)\.pb\.go$",
]


def to_posix(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def base_of(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def ext_of(p: Column) -> Column:
    base = base_of(p)
    return F.when(F.instr(base, ".") > 0, F.lower(F.substring_index(base, ".", -1))).otherwise(F.lit(""))


def module_of(p: Column) -> Column:
    """Parent folder, ``.`` for a bare name."""
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def stem_of(p: Column) -> Column:
    """Base name without extension; NULL for generic stems."""
    stem = F.regexp_replace(base_of(p), r"(?i)\.[a-z]+$", "")
    return F.when((F.length(stem) > 0) & ~F.lower(stem).isin(STOP_STEMS), stem)


def join_posix(folder: Column, rel: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of ``folder/rel``."""
    parts = F.filter(F.split(F.concat_ws("/", folder, rel), "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    return F.array_join(walked, "/")


def is_test(p: Column) -> Column:
    return base_of(p).rlike(TEST_NAME_RE) | p.rlike(TEST_DIR_RE)


def is_generated(p: Column) -> Column:
    base = base_of(p)
    first, *rest = [base.rlike(r) for r in GENERATED_RES]
    for cond in rest:
        first = first | cond
    return first


def is_source(p: Column) -> Column:
    return ext_of(p).isin(SOURCE_EXT) & ~is_test(p) & ~p.rlike(DECLARATION_RE) & ~is_generated(p)


def under_prefix(p: Column, target: str | Column) -> Column:
    """Path-boundary prefix test; ``.`` covers everything."""
    t = F.lit(target) if isinstance(target, str) else target
    return (t == ".") | (p == t) | p.startswith(F.concat(t, F.lit("/")))


def ancestors(p: Column) -> Column:
    """All path-boundary prefixes of ``p``, longest (``p`` itself) first."""
    parts = F.split(p, "/")
    return F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def suffixes(p: Column) -> Column:
    """All path-boundary suffixes of ``p``, longest first."""
    parts = F.split(p, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")
    )


def dotted_chain(name: Column) -> Column:
    """``a.b.c`` to ``[a.b.c, a.b, a]``."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )
