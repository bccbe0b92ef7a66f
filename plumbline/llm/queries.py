"""The queries of this package and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import divergence, html, language, line_dedup, line_rules, lm, mixing, ngram_join, packing, substrings, urls, vectors, whitening
from plumbline.llm.common import WORD, load, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@register("op2_line_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    weights = line_rules.learn(docs, load(spark, sf_dir, "labels").select("doc_id", "quality"))
    return line_rules.judge(docs, weights)


@register("op3_identify_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4), F.lit(0)) == 2
    model = language.learn(docs, ~held_out, F.col("doc_id"))
    found = language.identify(docs.select("text", "doc_id", held_out.alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@register("op4_pack")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def _url_sql() -> str:
    lower = "translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = []
    for r in sorted((r for r in urls.RULES), key=lambda r: (-r.rank, r.name)):
        host, slash, path = r.name.partition("/")
        fits.append((r, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"))
    rule = "CASE " + " ".join(f"WHEN {cond} THEN '{r.name}'" for r, cond in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r, _ in fits)
    words = sorted(urls.WORDS, key=lambda r: (-r.rank, r.name))
    pattern = "CASE " + " ".join(f"WHEN rule IS NULL AND regexp_matches(host || path, '{r.pattern}') THEN '{r.name}'" for r in words) + " END"
    verdict += " " + " ".join(f"WHEN pattern = '{r.name}' THEN '{r.verdict}'" for r in words) + " ELSE 'allow' END"
    return f"""
        WITH parts AS (
            SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's') AS h,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        hosts AS (SELECT page_id, {lower} AS host, path FROM parts),
        ruled AS (SELECT *, {rule} AS rule FROM hosts),
        named AS (SELECT *, {pattern} AS pattern FROM ruled)
        SELECT page_id, host, path, rule, pattern, {verdict} AS verdict FROM named"""


@register("op7_filter_urls", _url_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(load(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "pattern", "verdict")


MIX_SQL = f"""
    WITH sized AS (
        SELECT doc_id, source, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS sk,
               CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
               md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    placed AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized),
    sources AS (SELECT sk, sum(size) AS source_size, row_number() OVER (ORDER BY sk) - 1 AS rk FROM sized GROUP BY sk),
    weighted AS (SELECT *, [5, 2, 1][rk % 3 + 1] AS w FROM sources),
    levels AS (
        SELECT *, 2 * source_size AS cap, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (
                   ORDER BY 2.0 * source_size / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
               / sum(w) OVER (ORDER BY 2.0 * source_size / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
               AS level, 2.0 * source_size / w AS ratio FROM weighted),
    one AS (SELECT coalesce((SELECT level FROM levels WHERE level * w <= cap ORDER BY ratio, sk LIMIT 1), 0) AS level),
    aimed AS (SELECT sk, CAST(source_size AS BIGINT) AS source_size, least(cap::DOUBLE, one.level * w) AS target FROM levels, one),
    needed AS (SELECT *, CAST(round(target) AS BIGINT) AS need FROM aimed)
    SELECT doc_id, source, size, n.source_size, target,
           CASE WHEN n.source_size = 0 THEN 0 ELSE CAST(size * (need // n.source_size)
               + greatest(0, least(start + size, need % n.source_size) - start) AS BIGINT) END AS taken
    FROM placed JOIN needed n USING (sk)"""


@register("op9_mix", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"), F.col("doc_id"))
    return mixed.withColumnRenamed("doc_key", "doc_id")


@register("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(load(spark, sf_dir, "pages"), ["page_id", "url"])


@register("op10_ngram_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


@register("op6_link_vectors")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(load(spark, sf_dir, "embeddings"))


@register("op5_repeated_passages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find_repeats(load(spark, sf_dir, "documents")).drop("key", "text_hash")


@register("op1_score_texts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return lm.score(docs, F.coalesce(remainder(F.col("doc_id"), 10), F.lit(0)))


@register("op11_whiten")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(load(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_SQL = f"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM texts),
    keyed AS (SELECT *, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
    shared AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {line_dedup.CHARS}
        GROUP BY key HAVING count(DISTINCT r) >= {line_dedup.DOCUMENTS}),
    met AS (
        SELECT k.r, k.doc_id, k.line, k.pos, s.keeper IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < s.keeper) AS lost
        FROM keyed k LEFT JOIN shared s ON k.key = s.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
    FROM met GROUP BY r, doc_id"""


@register("op12_dedup_lines", LINE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


DIVERGENCE_SQL = f"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    found AS (
        SELECT r, lang, source, {LOWERED.format(r"unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))")} AS term FROM texts),
    kept AS (SELECT lang, term, count(*) AS total FROM found GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.DOCUMENTS}),
    langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM texts),
    sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
    shares AS (
        SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p,
               1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
        FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang)
        LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= {divergence.RANKS}"""


@register("op13_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))
