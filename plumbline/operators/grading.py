"""Grading of produced documents against expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.records import pct
from plumbline.plans.lineage import materialize
from plumbline.plans.skew import salted_join

# Grounding and recall tolerances.
GROUND_RADIUS = 3
GROUND_MIN_LINE = 5
RECALL_RADIUS = 60


def quote_matches(line: Column, want: Column) -> Column:
    """Both sides normalised: either contains the other, the line counting only above a minimum length."""
    return F.contains(line, want) | (F.contains(want, line) & (F.length(line) > GROUND_MIN_LINE))


def ground_quotes(
    evidence: DataFrame, lines: DataFrame, radius: int = GROUND_RADIUS, path: str = "path"
) -> DataFrame:
    """``ev_id, path, start_line, quote, verdict, hint``: does each quote occur near its cited line?

    ``evidence(ev_id, path, start_line, quote)``, ``lines(path, line_no, line)``.
    Verdicts: grounded, missing document, line beyond end, not found. Each
    citation emits its ``2 * radius + 1`` line numbers and meets the lines by an
    equi join; only quotes that fail look for the hint, the first line of their
    document that holds them, through an index of the document's words.
    """
    want = tx.strip_ellipsis(tx.norm_ws(F.col("quote")))
    cited = evidence.select("ev_id", path, "start_line", "quote", want.alias("_want"))
    norm = lines.select(path, "line_no", tx.norm_ws(F.col("line")).alias("_line"))
    lengths = lines.groupBy(path).agg(F.max("line_no").alias("_last"))
    near = cited.select(
        "ev_id",
        path,
        "_want",
        F.explode(F.sequence(F.greatest(F.col("start_line") - radius, F.lit(1)), F.col("start_line") + radius)).alias("line_no"),
    )
    grounded = (
        near.join(norm, [path, "line_no"])
        .where(quote_matches(F.col("_line"), F.col("_want")))
        .select("ev_id")
        .distinct()
        .withColumn("_ok", F.lit(True))
    )
    judged = cited.join(lengths, path, "left").join(grounded, "ev_id", "left")
    verdict = (
        F.when(F.col("_last").isNull(), "missing document")
        .when(F.col("start_line") > F.col("_last"), "line beyond end")
        .when(F.col("_ok"), "grounded")
        .otherwise("not found")
    )
    judged = judged.withColumn("verdict", verdict)
    lost = judged.where((F.col("verdict") == "not found") & (F.length("_want") > 0)).select("ev_id", path, "_want")
    hits = first_lines(materialize(lost, "lost"), norm, path)
    return judged.join(hits, "ev_id", "left").select("ev_id", path, "start_line", "quote", "verdict", "hint")


def first_lines(lost: DataFrame, norm: DataFrame, path: str) -> DataFrame:
    """``ev_id, hint``: the first line of the quote's document that contains it.

    ``lost(ev_id, path, _want)``, ``norm(path, line_no, _line)``, both with single spaces. All words of a quote but the
    first and the last stand in such a line as they are; the one that the fewest lines of the document hold fetches the
    lines to compare. A quote of one or two words meets the document's different words instead and takes those around
    its longer one. Documents stay cut into lines.
    """
    index = norm.join(lost.select(path).distinct(), path, "left_semi")
    index = index.select(path, "line_no", F.explode(F.array_distinct(F.split("_line", " "))).alias("word"))
    index = materialize(index.where("word != ''"), "word-index")
    held = materialize(index.groupBy(path, "word").agg(F.count(F.lit(1)).alias("held")), "words")
    parts = lost.withColumn("_parts", F.split("_want", " "))
    inner = F.array_distinct(F.slice("_parts", F.lit(2), F.size("_parts") - 2))
    long = parts.where(F.size("_parts") > 2).select("ev_id", path, F.explode(inner).alias("word"))
    # A word that the document lacks is held by no line, and fetches none.
    rarest = long.join(held, [path, "word"], "left").groupBy("ev_id", path).agg(
        F.min_by("word", F.struct(F.coalesce("held", F.lit(0)).alias("n"), "word")).alias("word")
    )
    longer = F.array_max(F.transform("_parts", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = parts.where(F.size("_parts") <= 2).select("ev_id", path, longer.alias("_piece"))
    around = salted_join(held.select(path, "word"), short, [path], spread_by=[F.col("word")]).where(F.contains("word", F.col("_piece")))
    asked = rarest.unionByName(around.select("ev_id", path, "word"))
    near = asked.join(index, [path, "word"]).select("ev_id", path, "line_no").distinct()
    met = near.join(norm, [path, "line_no"]).join(lost.select("ev_id", "_want"), "ev_id").where(F.contains("_line", F.col("_want")))
    return met.groupBy("ev_id").agg(F.min("line_no").alias("hint"))


def recall(ground: DataFrame, cites: DataFrame, radius: int = RECALL_RADIUS) -> DataFrame:
    """``item, matched, wanted, passed`` per ground-truth item.

    ``ground(item, path, line, min_files)`` (NULL line: any), ``cites(path, line)``.
    Lines are cut into bands of ``radius``; a ground line looks at its own band
    and the two next to it, so the band join is an equi join. Cites are
    reduced to distinct (path, line) first.
    """
    width = max(radius, 1)
    band = F.floor(F.col("line") / width).cast("bigint")
    seen = cites.select("path", "line").distinct()
    located = ground.where(F.col("line").isNotNull()).select(
        "item", "path", F.col("line").alias("want"), F.explode(F.array(band - 1, band, band + 1)).alias("band")
    )
    banded = seen.withColumn("band", band).withColumnsRenamed({"path": "_path", "line": "_line", "band": "_band"})
    # A semi join: an item is kept once, however many cites lie near it.
    near = located.join(
        banded,
        (F.col("path") == F.col("_path")) & (F.col("band") == F.col("_band")) & (F.abs(F.col("_line") - F.col("want")) <= radius),
        "left_semi",
    ).select("item", "path")
    anywhere = ground.where(F.col("line").isNull()).select("item", "path").join(seen.select("path").distinct(), "path", "left_semi")
    hits = near.unionByName(anywhere.select("item", "path")).distinct().groupBy("item").agg(F.count(F.lit(1)).alias("matched"))
    items = ground.groupBy("item").agg(
        F.count_distinct("path").alias("wanted"), F.max(F.coalesce("min_files", F.lit(1))).alias("min_files")
    )
    return items.join(hits, "item", "left").select(
        "item",
        F.coalesce("matched", F.lit(0)).alias("matched"),
        "wanted",
        (F.coalesce("matched", F.lit(0)) >= F.col("min_files")).alias("passed"),
    )


def absence(units: DataFrame, cites: DataFrame, rules: DataFrame) -> DataFrame:
    """``item, violations, passed``: fixed items that must not be reported again.

    ``units(unit_id, text, status)``, ``cites(unit_id, path)``,
    ``rules(item, first, second, pattern)``. A violation is one live unit that
    cites both documents of a rule and matches its pattern.
    """
    live = units.where(F.coalesce(~F.col("status").isin("withdrawn", "rejected"), F.lit(True)))
    cited = cites.select("unit_id", "path").distinct()
    both = (
        cited.join(rules.select("item", F.col("first").alias("path"), "second", "pattern"), "path")
        .select("unit_id", "item", F.col("second").alias("path"), "pattern")
        .join(cited, ["unit_id", "path"], "left_semi")
    )
    bad = (
        both.join(live.select("unit_id", "text"), "unit_id")
        .where(F.expr("regexp_like(text, concat('(?i)', pattern))"))
        .groupBy("item")
        .agg(F.count_distinct("unit_id").alias("violations"))
    )
    return rules.select("item").distinct().join(bad, "item", "left").select(
        "item",
        F.coalesce("violations", F.lit(0)).alias("violations"),
        F.col("violations").isNull().alias("passed"),
    )


def required_terms(docs: DataFrame, required: Sequence[str], forbidden: Sequence[str] = (), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, missing, forbidden_hits, passed``: patterns that must and must not occur."""
    missing = F.array_compact(F.array(*[F.when(~F.col(text).rlike(p), F.lit(p)) for p in required])) if required else F.array().cast("array<string>")
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(p)) for p in forbidden])) if forbidden else F.array().cast("array<string>")
    return docs.select(doc, missing.alias("missing"), hits.alias("forbidden_hits")).withColumn(
        "passed", (F.size("missing") == 0) & (F.size("forbidden_hits") == 0)
    )


def numeric_gate(docs: DataFrame, gates: Sequence[tuple[str, str, int | None]], doc: str = "doc_id", meta: str = "meta") -> DataFrame:
    """``doc, key, op, value, passed``: front-matter numbers against min, max, nonzero or present."""

    def check(key: str, op: str, bound: int | None) -> Column:
        raw = F.try_element_at(F.col(meta), F.lit(key))
        value = F.nullif(F.regexp_extract(raw, r"^\s*(-?\d+)", 1), F.lit("")).try_cast("bigint")
        ok = {
            "min": value >= F.lit(bound),
            "max": value <= F.lit(bound),
            "nonzero": value > 0,
            "present": raw.rlike(r"\S"),
        }[op]
        return F.struct(
            F.lit(key).alias("key"), F.lit(op).alias("op"), value.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")
        )

    return docs.select(doc, F.explode(F.array(*[check(*g) for g in gates])).alias("g")).select(doc, "g.*")


def section_routing(docs: DataFrame, specs: Sequence[tuple[str, str, str, str | None]], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, spec, passed``: a keyword lies under one section and not under another.

    ``specs`` are (id, keyword, in_section, not_in_section) patterns, matched
    without regard to case inside the row.
    """
    cut = docs.select(doc, tx.sections(F.col(text)).alias("secs"))

    def check(spec: tuple[str, str, str, str | None]) -> Column:
        name, keyword, inside, outside = spec
        hit = lambda where: F.exists(
            "secs", lambda s: s["heading"].rlike(f"(?i){where}") & s["body"].rlike(f"(?i){keyword}")
        )
        ok = hit(inside) & ~hit(outside) if outside else hit(inside)
        return F.struct(F.lit(name).alias("spec"), ok.alias("passed"))

    return cut.select(doc, F.explode(F.array(*[check(s) for s in specs])).alias("c")).select(doc, "c.*")


def citation_rate(resolved: DataFrame, doc: str = "doc_id", minimum: int = 100) -> DataFrame:
    """``doc, checked, resolvable, rate, passed``; a document without cites fails.

    ``resolved(doc, ok)`` has one row per cite, and a NULL ``ok`` for documents without any.
    """
    out = resolved.groupBy(doc).agg(F.count("ok").alias("checked"), F.count(F.when(F.col("ok"), 1)).alias("resolvable"))
    return out.withColumn("rate", pct(F.col("resolvable"), F.col("checked"))).withColumn(
        "passed", (F.col("rate") >= minimum) & (F.col("checked") > 0)
    )


def pass_rate(expectations: DataFrame, case: str = "case_id") -> DataFrame:
    """``case, passed, failed, pass_rate``; 0 for a case without expectations (NULL ``passed`` rows)."""
    return expectations.groupBy(case).agg(
        F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.count(F.when(~F.col("passed"), 1)).alias("failed"),
        F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
    )


def run_votes(runs: DataFrame, item: str = "item", hit: str = "hit") -> DataFrame:
    """``item, hits, runs, triggered``: majority over repeated runs."""
    return runs.groupBy(item).agg(
        F.sum(F.col(hit).cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("runs")
    ).withColumn("triggered", F.col("hits") * 2 > F.col("runs"))


def confusion(votes: DataFrame, truth: DataFrame, item: str = "item") -> DataFrame:
    """``tp, fp, tn, fn, accuracy, precision, recall`` in one row; NULL on an empty denominator."""
    j = votes.select(item, F.col("triggered").alias("got")).join(truth.select(item, F.col("should_trigger").alias("want")), item)
    n = lambda cond: F.count(F.when(cond, 1))
    got, want = F.col("got"), F.col("want")
    out = j.agg(
        n(want & got).alias("tp"), n(~want & got).alias("fp"), n(~want & ~got).alias("tn"), n(want & ~got).alias("fn")
    )
    share = lambda num, den: F.when(den > 0, F.floor(num * 100.0 / den + 0.5).cast("bigint"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select(
        "*",
        share(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
    )


def run_costs(runs: DataFrame, case: str = "case_id") -> DataFrame:
    """``case, total_tokens, duration_ms, cost, turns, any_error`` over four token counters."""
    tokens = sum(
        (F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")),
        F.lit(0).cast("bigint"),
    )
    return runs.groupBy(case).agg(
        F.sum(tokens).alias("total_tokens"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum("cost").alias("cost"),
        F.sum("turns").alias("turns"),
        F.bool_or(F.coalesce("is_error", F.lit(False))).alias("any_error"),
    )


def compound_contract(
    compounds: DataFrame, cites: DataFrame, constituents: DataFrame, supplied: DataFrame, min_files: int = 2
) -> DataFrame:
    """``compound, files, bad_quotes, alien, parsed, passed`` per compound.

    ``cites(compound, path, resolved, grounded)``, ``constituents(compound, id)``,
    ``supplied(id)``: at least two distinct resolved documents, all quotes
    grounded, at least one constituent and none outside the supplied set.
    """
    files = cites.groupBy("compound").agg(
        F.count_distinct(F.when(F.col("resolved"), F.col("path"))).alias("files"),
        F.count(F.when(F.col("grounded") == F.lit(False), 1)).alias("bad_quotes"),
    )
    known = supplied.select("id").distinct().withColumn("_known", F.lit(True))
    parts = constituents.distinct().join(known, "id", "left").groupBy("compound").agg(
        F.count(F.lit(1)).alias("parsed"), F.count(F.when(F.col("_known").isNull(), 1)).alias("alien")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = (
        compounds.select("compound").distinct().join(files, "compound", "left").join(parts, "compound", "left")
        .select("compound", zero("files"), zero("bad_quotes"), zero("alien"), zero("parsed"))
    )
    return out.withColumn(
        "passed",
        (F.col("files") >= min_files) & (F.col("bad_quotes") == 0) & (F.col("alien") == 0) & (F.col("parsed") > 0),
    )
