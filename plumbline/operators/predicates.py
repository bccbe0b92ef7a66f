"""Row filters, tagging and document lint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions import text as tx
from plumbline.functions.problems import found, problem
from plumbline.functions.hashing import body_hash
from plumbline.plans.lineage import materialize

# First matching rule wins.
ROLE_RULES = [
    ("boundary", r"(?!)"),
    ("persistence", r"(?i)migration|schema|repository|dao|model"),
    ("test", r"/test|/spec|__tests__|\.test\.|\.spec\.|_test\.|Test\."),
    ("config", r"(^|/)(package(-lock)?\.json|[^/]*\.lock|[^/]*\.toml|[^/]*\.ya?ml|\.env[^/]*|settings[^/]*)$"),
]
HUB_MIN_CONSUMERS = 3

# Literal sink classes and risk keywords.
SINK_RULES = [
    ("command-exec", r"(?<![A-Za-z0-9_])exec(?:Sync)?\(|(?<![A-Za-z0-9_])spawn\([^)]*shell:|subprocess\.run\(|Popen\([^)]*shell=True|os\.system\(|Runtime\.exec"),
    ("path-traversal", r"(?:readFile|writeFile|createReadStream|sendFile|(?<![A-Za-z0-9_])open)\([^)]*(?:\+|\$\{)|path\.join\([^)]*(?:req|user|param)"),
    ("ssrf", r"(?:(?<![A-Za-z0-9_])fetch\(|axios|https?\.get\(|(?<![A-Za-z0-9_])request\(|urllib|HttpClient)\s*(?![\s(]*['\"])"),
    ("secrets-in-diff", r"(?i)[A-Z_]*(?:KEY|SECRET|TOKEN|PASSWORD|PASSWD)[A-Z_]*\s*[:=]\s*['\"][^'\"]{12,}['\"]|-----BEGIN [A-Z ]*PRIVATE KEY-----|://[^\s:/@]+:[^\s/@]+@"),
]
RISK_KEYWORD_RE = r"TODO|FIXME|HACK|XXX|debugger|console\.(?:log|error|warn)"

# Required front-matter fields, extra ones by document kind.
CORE_FIELDS = ["date", "author", "commit", "branch", "repository", "status"]
EXTRA_FIELDS = {
    "discover": ["topic", "last_updated", "last_updated_by"],
    "validation": ["topic", "last_updated", "last_updated_by"],
    "architecture-reviews": ["last_updated", "last_updated_by"],
}
TOKEN_RE = r"(?<!\$)\{[a-zA-Z][^{}\n]{0,50}\}"
PLACEHOLDER_RE = r"(?<![A-Za-z0-9_])(TODO|TBD|FIXME)(?![A-Za-z0-9_])"
FENCE_RE = r"```([^\n]*)\n([\s\S]*?)```"

# Commit type to changelog section, and subjects always skipped.
COMMIT_SECTIONS = {
    "feat": "Added", "fix": "Fixed", "perf": "Performance", "refactor": "Changed", "style": "Changed", "build": "Changed",
    "ci": "Changed", "chore": "Changed", "docs": "Changed", "revert": "Changed",
}
COMMIT_RE = r"^([a-z]+)(?:\(([^)]*)\))?(!)?:\s*(.*)$"
SKIP_SUBJECT_RE = (
    r"^Release v\d+\.\d+\.\d+|^chore\(release\): v\d+\.\d+\.\d+|^Add \[Unreleased\] section for next cycle"
    r"|^v?\d+\.\d+\.\d+$|^Merge "
)


def source_filter(docs: DataFrame, path: str = "path") -> DataFrame:
    """Source documents: known extension, no tests, declarations or generated text."""
    return docs.where(paths.is_source(F.col(path)))


def under_prefix(df: DataFrame, col: str, targets: Sequence[str]) -> DataFrame:
    """Rows under any of the target prefixes; a handful of targets stays a plain filter."""
    cond = F.lit(False)
    for t in targets:
        cond = cond | paths.under_prefix(F.col(col), t)
    return df.where(cond)


def under_prefixes(df: DataFrame, col: str, targets: DataFrame, target: str = "target") -> DataFrame:
    """Rows under any target of a large target table, by an equi join on ancestor prefixes."""
    keys = df.select(F.col(col)).distinct()
    up = keys.select(col, F.explode(paths.ancestors(F.col(col))).alias("_up"))
    hit = up.join(targets.select(F.col(target).alias("_up")).distinct(), "_up", "left_semi").select(col).distinct()
    return df.join(hit, col, "left_semi")


def role_tag(
    df: DataFrame,
    path: str = "path",
    boundary: Column | None = None,
    wiring: Column | None = None,
    consumers: Column | None = None,
    rules: Sequence[tuple[str, str]] = ROLE_RULES,
    out: str = "role",
) -> DataFrame:
    """One tag per row, the first match wins; ``code`` by default.

    ``boundary`` and ``wiring`` are optional flags from other sources and
    ``consumers`` the inbound count that makes a hub.
    """
    tag: Column | None = None
    for name, pattern in rules:
        cond = F.col(path).rlike(pattern)
        if name == "boundary" and boundary is not None:
            cond = cond | boundary
        if name == "config" and wiring is not None:
            cond = cond | wiring
        tag = F.when(cond, F.lit(name)) if tag is None else tag.when(cond, F.lit(name))
    if consumers is not None:
        hub = consumers >= HUB_MIN_CONSUMERS
        tag = F.when(hub, F.lit("hub")) if tag is None else tag.when(hub, F.lit("hub"))
    return df.withColumn(out, tag.otherwise(F.lit("code")))


def pattern_scan(docs: DataFrame, rules: Sequence[tuple[str, str]], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, line_no, rule, idiom``: every line that matches a literal rule, with the matched text.

    All rules are tested on each line inside the row; only hits are emitted.
    """
    rule_hits = lambda line: F.array_compact(
        F.array(
            *[
                F.when(
                    line.rlike(p),
                    F.struct(F.lit(n).alias("rule"), F.regexp_extract(line, p, 0).alias("idiom")),
                )
                for n, p in rules
            ]
        )
    )
    per_line = F.transform(
        tx.lines(F.col(text)), lambda l, i: F.struct((i + 1).alias("line_no"), rule_hits(l).alias("hits"))
    )
    return (
        docs.select(doc, F.explode(F.filter(per_line, lambda x: F.size(x["hits"]) > 0)).alias("x"))
        .select(doc, "x.line_no", F.explode("x.hits").alias("h"))
        .select(doc, "line_no", "h.rule", "h.idiom")
    )


def lint_errors(fm: Column, body: Column, kind: Column, finalizing: bool = False) -> Column:
    """Array of problems (``code, field, value``) of one document."""
    value = lambda k: F.try_element_at(fm, F.lit(k))
    unset = lambda k: F.coalesce(F.length(tx.trim_ws(value(k))) == 0, F.lit(True))
    pinned = tx.trim_ws(value("content_hash"))
    fields = [(unset(k), problem("empty", k)) for k in CORE_FIELDS]
    fields += [((kind == name) & unset(k), problem("empty", k)) for name, keys in EXTRA_FIELDS.items() for k in keys]
    fields += [((F.length(pinned) > 0) & (body_hash(body) != pinned), problem("stale", "content_hash", pinned))]
    each = lambda values, code: F.transform(F.array_distinct(values), lambda t: problem(code, None, t))
    fences = F.filter(
        tx.extract_tokens(body, FENCE_RE, 0), lambda b: F.length(tx.trim_ws(F.regexp_extract(b, FENCE_RE, 2))) == 0
    )
    closing = F.coalesce(value("status") == "ready", F.lit(False)) | F.lit(finalizing)
    tokens = lambda prose: F.concat(
        each(F.when(closing, tx.extract_tokens(prose, TOKEN_RE, 0)).otherwise(F.array().cast("array<string>")), "open_token"),
        each(tx.extract_tokens(prose, PLACEHOLDER_RE, 1), "placeholder"),
    )
    return F.concat(
        found(fields),
        tx.bind(tx.strip_code(body), tokens),
        F.transform(fences, lambda b: problem("empty_fence", None, F.trim(F.regexp_extract(b, FENCE_RE, 1)))),
    )


def doc_lint(
    docs: DataFrame,
    doc: str = "path",
    text: str = "text",
    kind: Column | None = None,
    universe: DataFrame | None = None,
    finalizing: bool = False,
) -> DataFrame:
    """``doc, code, field, value``: one row per lint finding.

    ``universe`` (paths of existing documents) enables the parent check, an
    anti join of declared parents.
    """
    kind_col = kind if kind is not None else F.regexp_extract(F.col(doc).cast("string"), r"(?:^|/)artifacts/([^/]+)/", 1)
    prepared = docs.select(
        F.col(doc),
        tx.front_matter(F.col(text)).alias("fm"),
        tx.body_of(F.col(text)).alias("body"),
        kind_col.alias("kind"),
    )
    problems = lint_errors(F.col("fm"), F.col("body"), F.col("kind"), finalizing)
    if universe is None:
        return prepared.select(doc, F.explode(problems).alias("e")).select(doc, "e.*")
    # The texts are read once: a declared parent is a finding until it is known to exist.
    parent = problem("lost", "parent", F.try_element_at("fm", F.lit("parent")))
    declared = F.filter(F.array(parent), lambda p: (F.length(p["value"]) > 0) & ~p["value"].rlike(r"[{}]"))
    rows = materialize(prepared.select(doc, F.explode(F.concat(problems, declared)).alias("e")), "lint")
    known = universe.select(F.col("path").alias("_parent")).distinct()
    lost = rows.where("e.code = 'lost'").withColumn("_parent", F.col("e.value")).join(known, "_parent", "left_anti")
    return rows.where("e.code != 'lost'").unionByName(lost.select(doc, "e")).select(doc, "e.*")


def conventional_commit(commits: DataFrame, subject: str = "subject", body: str | None = None) -> DataFrame:
    """Adds ``type, scope, section, breaking``; skipped and test commits are dropped.

    A breaking change yields a second row in its own section.
    """
    s = F.col(subject)
    section = F.try_element_at(F.create_map(*[F.lit(x) for kv in COMMIT_SECTIONS.items() for x in kv]), F.col("type"))
    breaking = F.regexp_extract(s, COMMIT_RE, 3) == "!"
    if body is not None:
        breaking = breaking | F.coalesce(F.col(body).rlike(r"(?m)^BREAKING CHANGE:"), F.lit(False))
    parsed = (
        commits.where(~s.rlike(SKIP_SUBJECT_RE))
        .withColumn("type", F.regexp_extract(s, COMMIT_RE, 1))
        .withColumn("scope", F.nullif(F.regexp_extract(s, COMMIT_RE, 2), F.lit("")))
        .withColumn("breaking", breaking)
        .withColumn("_section", section)
        .where(F.col("_section").isNotNull())
    )
    rows = F.when(F.col("breaking"), F.array(F.col("_section"), F.lit("Breaking / Upgrade Notes"))).otherwise(F.array("_section"))
    return parsed.withColumn("section", F.explode(rows)).drop("_section")
