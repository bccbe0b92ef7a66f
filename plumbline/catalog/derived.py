"""Operator inputs derived from the driver's tables, in Spark and in SQL.

A document row is a file, an order a commit, a part a module, a consecutive
pair of order lines an import edge, and a labelled document a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import sql_fingerprint, sql_lines, sql_loc, table
from plumbline.functions import text as tx
from plumbline.functions.hashing import fingerprint
from plumbline.operators.findings import LENSES

# ---- documents as files ----------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, text, lang, source, n_chars, path``."""
    return table(spark, d, "documents").withColumn(
        "path", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    )


def sized_docs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("loc", tx.non_blank_loc(F.col("text")))


DOCS = f"""docs AS (
  SELECT doc_id, text, lang, source, n_chars, source || '/' || lang || '/d' || doc_id || '.md' AS path,
         {sql_loc('text')} AS loc
  FROM documents)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, path, line_no, line``."""
    return docs(spark, d).select("doc_id", "path", F.posexplode(tx.lines(F.col("text"))).alias("pos", "line")).select(
        "doc_id", "path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


LINES = f"""lines AS (
  SELECT doc_id, path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, path, {sql_lines('text')} AS l FROM docs))"""

# ---- parts as modules, consecutive order lines as edges ---------------------------------


def modules(spark: SparkSession, d: str) -> DataFrame:
    """``partkey, path``: ``Brand7/p42``."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("partkey"),
        F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("/p"), F.col("p_partkey").cast("string")).alias("path"),
    )


MODULES = "modules AS (SELECT p_partkey AS partkey, replace(p_brand, '#', '') || '/p' || p_partkey AS path FROM part)"


def part_steps(spark: SparkSession, d: str) -> DataFrame:
    """``a, b, n``: how often part b directly follows part a in an order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = li.select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("a"))
    second = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("k"), F.col("l_partkey").alias("b"))
    return (
        first.join(second, ["l_orderkey", "k"]).where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    )


PART_STEPS = """steps AS (
  SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
  WHERE x.l_partkey <> y.l_partkey GROUP BY ALL)"""


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst`` module paths."""
    m = modules(spark, d)
    s = part_steps(spark, d)
    return s.join(m.select(F.col("partkey").alias("a"), F.col("path").alias("src")), "a").join(
        m.select(F.col("partkey").alias("b"), F.col("path").alias("dst")), "b"
    ).select("src", "dst")


PART_EDGES = f"""{MODULES}, {PART_STEPS}, edges AS (
  SELECT ma.path AS src, mb.path AS dst FROM steps JOIN modules ma ON ma.partkey = a JOIN modules mb ON mb.partkey = b)"""


def main_successor(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst`` part keys: each part's most frequent successor, smallest key on a tie."""
    return (
        part_steps(spark, d)
        .groupBy(F.col("a").alias("src"))
        .agg(F.max_by("b", F.struct("n", (-F.col("b")).alias("m"))).alias("dst"))
    )


SUCCESSOR = f"""{PART_STEPS}, succ AS (
  SELECT a AS src, b AS dst FROM steps QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1)"""

# ---- orders as commits -------------------------------------------------------------


def supply_changes(spark: SparkSession, d: str) -> DataFrame:
    """``basket_id, item``: suppliers of an order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_suppkey").alias("item"))


def event_changes(spark: SparkSession, d: str) -> DataFrame:
    """``item, actor, ts``: users as items, event types as actors."""
    return table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("actor"), "ts")


# ---- labelled documents as findings ---------------------------------------------------


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings in the schema of ``operators.findings``, one per document; some are invalid on purpose."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    t = docs(spark, d).join(labels, "doc_id", "left")
    n = F.col("doc_id")
    ar = n % 5 != 0
    chars = F.col("n_chars")
    nothing = F.lit(None).cast("string")
    listed = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return t.select(
        F.concat(F.lit("F"), n.cast("string")).alias("id"),
        F.when(ar, "ar").otherwise("dr").alias("kind"),
        F.concat((n % 3).cast("string"), F.when(n % 4 == 0, ".1").otherwise("")).alias("layer"),
        F.when(ar, _pick(LENSES["ar"], n)).otherwise(_pick(LENSES["dr"], n)).alias("lens"),
        F.concat(F.col("lang"), F.lit(" document "), n.cast("string")).alias("title"),
        F.array(
            F.struct(
                F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".md")).alias("path"),
                (n % 10 + 1).cast("int").alias("startLine"),
                F.when(n % 13 == 0, 0).cast("int").alias("endLine"),
                tx.lines(F.col("text")).alias("quoted"),
            )
        ).alias("evidence"),
        F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")).alias("symbol"),
        F.col("source").alias("anchor"),
        F.concat(F.lit("text of "), chars.cast("string"), F.lit(" characters")).alias("what"),
        F.when(n % 7 != 0, F.concat(F.lit("why "), F.col("source"))).alias("why"),
        F.when(n % 11 != 0, F.concat(F.lit("fix "), F.col("lang"))).alias("fix"),
        nothing.alias("alt"),
        F.when(
            n % 17 != 0,
            F.struct(
                listed("step").alias("steps"), listed("accepted").alias("acceptance"), F.lit("unit").alias("testStrategy"), F.lit("none").alias("tradeoff")
            ),
        ).alias("remediation"),
        F.when(ar, F.when(chars < 300, "Low").when(chars < 1200, "Med").otherwise("High"))
        .otherwise(F.when(chars < 300, "discuss").when(chars < 1200, "suggestion").when(chars < 3000, "important").otherwise("critical"))
        .alias("severity"),
        _pick(["S", "M", "L"], n).alias("effort"),
        F.when(n % 4 == 0, listed("internal"))
        .when(n % 4 == 1, listed("cross-module", "public-API"))
        .when(n % 4 == 2, listed("on-disk"))
        .otherwise(listed("other"))
        .alias("blastRadius"),
        _pick(["polish", "redesign"], n).alias("class"),
        F.col("source").alias("entityStage"),
        F.when(F.col("lang") == "en", "Verified").when(F.col("lang") == "fr", "Weakened").when(F.col("lang") == "de", "Falsified").alias("verify"),
        nothing.alias("verifyNote"),
        F.when(F.col("toxic") == 1, "rejected")
        .when(F.col("quality") == 1, "accepted")
        .when(F.col("quality") == 0, "deferred")
        .otherwise("open")
        .alias("status"),
        nothing.alias("statusNote"),
        F.when(n % 4 == 1, F.array(F.concat(F.lit("F"), (n - 1).cast("string")))).otherwise(F.array().cast("array<string>")).alias("dependsOn"),
        F.when(n % 6 != 0, F.concat(F.lit("tag"), (n % 5).cast("string"))).alias("crossCutTag"),
        nothing.alias("baselineState"),
        nothing.alias("driftClass"),
        nothing.alias("priorFp"),
        nothing.alias("priorId"),
    ).withColumn("fp", fingerprint(F.col("lens"), F.flatten(F.transform("evidence", lambda e: e["quoted"])), F.col("symbol")))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FINDINGS = f"""{DOCS}, lab AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
raw_findings AS (
  SELECT docs.doc_id AS n, 'F' || docs.doc_id AS id,
    CASE WHEN docs.doc_id % 5 <> 0 THEN 'ar' ELSE 'dr' END AS kind,
    (docs.doc_id % 3) || CASE WHEN docs.doc_id % 4 = 0 THEN '.1' ELSE '' END AS layer,
    CASE WHEN docs.doc_id % 5 <> 0 THEN {_sql_list(LENSES['ar'])}[docs.doc_id % 16 + 1]
         ELSE {_sql_list(LENSES['dr'])}[docs.doc_id % 4 + 1] END AS lens,
    lang || ' document ' || docs.doc_id AS title,
    source || '/' || lang || '.md' AS ev_path, docs.doc_id % 10 + 1 AS ev_start,
    CASE WHEN docs.doc_id % 13 = 0 THEN 0 END AS ev_end,
    {sql_lines('text')} AS quoted,
    nullif(regexp_extract(text, '[A-Za-z]+'), '') AS symbol,
    source AS anchor,
    CASE WHEN docs.doc_id % 7 <> 0 THEN 'why ' || source END AS why,
    CASE WHEN docs.doc_id % 11 <> 0 THEN 'fix ' || lang END AS fix,
    docs.doc_id % 17 <> 0 AS has_remediation,
    CASE WHEN docs.doc_id % 5 <> 0
         THEN CASE WHEN n_chars < 300 THEN 'Low' WHEN n_chars < 1200 THEN 'Med' ELSE 'High' END
         ELSE CASE WHEN n_chars < 300 THEN 'discuss' WHEN n_chars < 1200 THEN 'suggestion'
                   WHEN n_chars < 3000 THEN 'important' ELSE 'critical' END END AS severity,
    ['S', 'M', 'L'][docs.doc_id % 3 + 1] AS effort,
    CASE docs.doc_id % 4 WHEN 0 THEN ['internal'] WHEN 1 THEN ['cross-module', 'public-API']
                         WHEN 2 THEN ['on-disk'] ELSE ['other'] END AS blast,
    source AS entity_stage, source, lang,
    CASE lang WHEN 'en' THEN 'Verified' WHEN 'fr' THEN 'Weakened' WHEN 'de' THEN 'Falsified' END AS verify,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'deferred' ELSE 'open' END AS status,
    CASE WHEN docs.doc_id % 4 = 1 THEN 'F' || (docs.doc_id - 1) END AS needs,
    CASE WHEN docs.doc_id % 6 <> 0 THEN 'tag' || (docs.doc_id % 5) END AS tag
  FROM docs LEFT JOIN lab ON docs.doc_id = lab.doc_id),
findings AS (SELECT *, {sql_fingerprint('lens', 'quoted', 'symbol')} AS fp FROM raw_findings)"""

