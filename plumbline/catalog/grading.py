"""Grading queries: benchmark passages against documents, labels against rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, sql_lines, sql_norm, table
from plumbline.catalog.derived import DOCS, LINES, doc_lines, docs
from plumbline.catalog.text import ARTIFACT, artifacts
from plumbline.functions import text as tx
from plumbline.operators import grading

# Evidence: the first line of every document, cited at a line that is right, near, far off or beyond the end.
EVIDENCE = f"""ev AS (SELECT 'e' || doc_id AS ev_id, CASE WHEN doc_id % 11 = 0 THEN path || 'x' ELSE path END AS path,
    CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 400 END AS start_line, {sql_lines('text')}[1] AS quote FROM docs),
nl AS (SELECT path, line_no, {sql_norm('line')} AS line FROM lines), ln AS (SELECT path, max(line_no) AS last FROM lines GROUP BY path),
w AS (SELECT *, {sql_norm('quote')} AS want FROM ev)"""


def evidence(spark, d):
    n = F.col("doc_id")
    return docs(spark, d).select(
        F.concat(F.lit("e"), n.cast("string")).alias("ev_id"),
        F.when(n % 11 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"),
        F.when(n % 4 == 0, 1).when(n % 4 == 1, 4).when(n % 4 == 2, 5).otherwise(400).cast("bigint").alias("start_line"),
        F.element_at(tx.lines(F.col("text")), 1).alias("quote"),
    )


@query(
    "ground_quotes",
    f"""WITH {DOCS}, {LINES}, {EVIDENCE}, g AS (SELECT DISTINCT ev_id FROM w JOIN nl ON nl.path = w.path AND line_no BETWEEN start_line - 3 AND start_line + 3
        WHERE contains(line, want) OR (contains(want, line) AND length(line) > 5)),
    j AS (SELECT w.ev_id, w.path, want, CASE WHEN last IS NULL THEN 'missing document' WHEN start_line > last THEN 'line beyond end' WHEN g.ev_id IS NOT NULL THEN 'grounded' ELSE 'not found' END AS verdict
      FROM w LEFT JOIN ln ON ln.path = w.path LEFT JOIN g ON g.ev_id = w.ev_id)
    SELECT ev_id, verdict, CASE WHEN verdict = 'not found' AND length(want) > 0 THEN (SELECT min(line_no) FROM nl WHERE nl.path = j.path AND contains(line, want)) END AS hint FROM j""",
)
def ground_quotes(spark, d):
    lines = doc_lines(spark, d).select("path", "line_no", "line")
    return grading.ground_quotes(evidence(spark, d), lines).select("ev_id", "verdict", "hint")


GROUND = """gt AS (SELECT l_orderkey % 500 AS item, l_suppkey AS path, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey END AS line, 2 AS min_files FROM lineitem WHERE l_returnflag = 'R'),
ct AS (SELECT l_suppkey AS path, l_partkey AS line FROM lineitem WHERE l_returnflag = 'A')"""


@query(
    "recall",
    f"""WITH {GROUND}, h AS (SELECT item, count(DISTINCT gt.path) AS matched FROM gt WHERE EXISTS (SELECT 1 FROM ct WHERE ct.path = gt.path AND (gt.line IS NULL OR abs(ct.line - gt.line) <= 5)) GROUP BY item),
    i AS (SELECT item, count(DISTINCT path) AS wanted FROM gt GROUP BY item)
    SELECT item, coalesce(matched, 0) AS matched, wanted, coalesce(matched, 0) >= 2 AS passed FROM i LEFT JOIN h USING (item)""",
)
def recall(spark, d):
    li = table(spark, d, "lineitem")
    ground = li.where("l_returnflag = 'R'").select(
        (F.col("l_orderkey") % 500).alias("item"),
        F.col("l_suppkey").alias("path"),
        F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("line"),
        F.lit(2).alias("min_files"),
    )
    cites = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("line"))
    return grading.recall(ground, cites, radius=5)


@query(
    "absence",
    """WITH u AS (SELECT o_orderkey AS unit_id, o_orderpriority AS text, CASE o_orderstatus WHEN 'P' THEN 'withdrawn' ELSE 'open' END AS status FROM orders),
    r AS (SELECT s_suppkey AS item, s_suppkey AS first, s_suppkey + 1 AS second, 'urgent|high' AS pattern FROM supplier),
    c AS (SELECT DISTINCT l_orderkey AS unit_id, l_suppkey AS path FROM lineitem),
    b AS (SELECT item, count(DISTINCT x.unit_id) AS violations FROM r JOIN c x ON x.path = first JOIN c y ON y.path = second AND y.unit_id = x.unit_id JOIN u ON u.unit_id = x.unit_id
      WHERE status <> 'withdrawn' AND regexp_matches(text, '(?i)urgent|high') GROUP BY item)
    SELECT item, coalesce(violations, 0) AS violations, violations IS NULL AS passed FROM r LEFT JOIN b USING (item)""",
)
def absence(spark, d):
    units = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_orderstatus") == "P", "withdrawn").otherwise("open").alias("status"),
    )
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("path"))
    key = F.col("s_suppkey")
    rules = table(spark, d, "supplier").select(
        key.alias("item"), key.alias("first"), (key + 1).alias("second"), F.lit("urgent|high").alias("pattern")
    )
    return grading.absence(units, cites, rules)


REQUIRED = ["[.]", "(?i)the", "[A-Z][a-z]+ "]
FORBIDDEN = ["!!", "@"]


@query(
    "required_terms",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN NOT regexp_matches(text, '{p}') THEN '{p}' END" for p in REQUIRED)
    + "], lambda x: x IS NOT NULL), ',') AS missing, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{p}' END" for p in FORBIDDEN)
    + "], lambda x: x IS NOT NULL), ',') AS forbidden_hits, "
    + " AND ".join(f"regexp_matches(text, '{p}')" for p in REQUIRED)
    + " AND "
    + " AND ".join(f"NOT regexp_matches(text, '{p}')" for p in FORBIDDEN)
    + " AS passed FROM documents",
)
def required_terms(spark, d):
    out = grading.required_terms(table(spark, d, "documents"), REQUIRED, FORBIDDEN)
    return out.withColumn("missing", F.array_join("missing", ",")).withColumn("forbidden_hits", F.array_join("forbidden_hits", ","))


@query(
    "numeric_gate",
    """WITH a AS (SELECT doc_id, n_chars, doc_id % 3 <> 0 AS has_commit FROM documents)
    SELECT doc_id, 'n_chars' AS key, 'max' AS op, n_chars AS value, n_chars <= 1000 AS passed FROM a UNION ALL SELECT doc_id, 'n_chars', 'min', n_chars, n_chars >= 300 FROM a
    UNION ALL SELECT doc_id, 'n_chars', 'nonzero', n_chars, n_chars > 0 FROM a UNION ALL SELECT doc_id, 'commit', 'present', NULL, has_commit FROM a UNION ALL SELECT doc_id, 'author', 'min', NULL, false FROM a""",
)
def numeric_gate(spark, d):
    meta = artifacts(spark, d).select("doc_id", tx.front_matter(F.col("text")).alias("meta"))
    gates = [("n_chars", "max", 1000), ("n_chars", "min", 300), ("n_chars", "nonzero", None), ("commit", "present", None), ("author", "min", 1)]
    return grading.numeric_gate(meta, gates)


@query(
    "section_routing",
    f"""WITH {ARTIFACT}, s AS (SELECT doc_id, lang, source, regexp_matches(text, '(?i)the') AS whole, regexp_matches(regexp_extract(text, '(?s)## Goals\\n(.*)\\n## Follow-ups', 1), '(?i)the') AS goals FROM artifacts)
    SELECT doc_id, 'goal' AS spec, goals AS passed FROM s UNION ALL SELECT doc_id, 'aside', true FROM s""",
)
def section_routing(spark, d):
    return grading.section_routing(artifacts(spark, d), [("goal", "the", "^goals", None), ("aside", "follow up for src", "follow", "zzz")])


@query(
    "pass_rate",
    """WITH e AS (SELECT source AS case_id, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 AND toxic = 0 END AS passed FROM documents LEFT JOIN labels USING (doc_id))
    SELECT case_id, count(CASE WHEN passed THEN 1 END) AS passed, count(CASE WHEN NOT passed THEN 1 END) AS failed, round(coalesce(avg(CAST(passed AS DOUBLE)), 0.0), 6) AS pass_rate FROM e GROUP BY case_id""",
)
def pass_rate(spark, d):
    e = (
        table(spark, d, "documents")
        .select("doc_id", F.col("source").alias("case_id"))
        .join(table(spark, d, "labels"), "doc_id", "left")
        .select("case_id", F.when(F.col("quality").isNotNull(), (F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"))
    )
    return grading.pass_rate(e).withColumn("pass_rate", F.round("pass_rate", 6))


VOTES = """runs AS (SELECT o_custkey AS item, o_orderstatus = 'F' OR o_totalprice > 300000 AS hit FROM orders),
votes AS (SELECT item, count(CASE WHEN hit THEN 1 END) AS hits, count(*) AS runs, count(CASE WHEN hit THEN 1 END) * 2 > count(*) AS triggered FROM runs GROUP BY item),
truth AS (SELECT c_custkey AS item, c_acctbal > 4000 AS should_trigger FROM customer)"""


def _votes(spark, d):
    runs = table(spark, d, "orders").select(
        F.col("o_custkey").alias("item"), ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 300000)).alias("hit")
    )
    return grading.run_votes(runs)


@query("run_votes", f"WITH {VOTES} SELECT * FROM votes")
def run_votes(spark, d):
    return _votes(spark, d)


@query(
    "confusion",
    f"""WITH {VOTES}, c AS (SELECT count(CASE WHEN should_trigger AND triggered THEN 1 END) AS tp, count(CASE WHEN NOT should_trigger AND triggered THEN 1 END) AS fp,
      count(CASE WHEN NOT should_trigger AND NOT triggered THEN 1 END) AS tn, count(CASE WHEN should_trigger AND NOT triggered THEN 1 END) AS fn FROM votes JOIN truth USING (item))
    SELECT *, CASE WHEN tp + fp + tn + fn > 0 THEN CAST(floor((tp + tn) * 100.0 / (tp + fp + tn + fn) + 0.5) AS BIGINT) END AS accuracy,
      CASE WHEN tp + fp > 0 THEN CAST(floor(tp * 100.0 / (tp + fp) + 0.5) AS BIGINT) END AS precision, CASE WHEN tp + fn > 0 THEN CAST(floor(tp * 100.0 / (tp + fn) + 0.5) AS BIGINT) END AS recall FROM c""",
)
def confusion(spark, d):
    truth = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_acctbal") > 4000).alias("should_trigger"))
    return grading.confusion(_votes(spark, d), truth)


@query(
    "run_costs",
    """SELECT l_suppkey AS case_id, CAST(sum(CAST(l_quantity AS BIGINT) + coalesce(CASE WHEN l_returnflag = 'R' THEN l_partkey END, 0) + l_linenumber + 1) AS BIGINT) AS total_tokens,
      CAST(sum(l_orderkey) AS BIGINT) AS duration_ms, round(sum(l_tax), 4) AS cost, CAST(sum(l_linenumber) AS BIGINT) AS turns, bool_or(coalesce(CASE WHEN l_discount > 0.09 THEN l_returnflag = 'A' END, false)) AS any_error
    FROM lineitem GROUP BY l_suppkey""",
)
def run_costs(spark, d):
    runs = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("case_id"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"),
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("output_tokens"),
        F.col("l_linenumber").cast("bigint").alias("cache_creation_tokens"),
        F.lit(1).cast("bigint").alias("cache_read_tokens"),
        F.col("l_orderkey").alias("duration_ms"),
        F.col("l_tax").alias("cost"),
        F.col("l_linenumber").cast("bigint").alias("turns"),
        F.when(F.col("l_discount") > 0.09, F.col("l_returnflag") == "A").alias("is_error"),
    )
    return grading.run_costs(runs).withColumn("cost", F.round("cost", 4))


@query(
    "compound_contract",
    """WITH f AS (SELECT l_orderkey AS compound, count(DISTINCT CASE WHEN l_quantity > 5 THEN l_suppkey END) AS files, count(CASE WHEN l_returnflag = 'A' AND l_discount > 0.09 THEN 1 END) AS bad_quotes FROM lineitem GROUP BY 1),
    p AS (SELECT compound, count(*) AS parsed, count(CASE WHEN p_partkey IS NULL THEN 1 END) AS alien FROM (SELECT DISTINCT l_orderkey AS compound, l_partkey AS id FROM lineitem) c LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 45) ON p_partkey = id GROUP BY 1)
    SELECT o_orderkey AS compound, coalesce(files, 0) AS files, coalesce(bad_quotes, 0) AS bad_quotes, coalesce(alien, 0) AS alien, coalesce(parsed, 0) AS parsed,
      coalesce(files, 0) >= 2 AND coalesce(bad_quotes, 0) = 0 AND coalesce(alien, 0) = 0 AND coalesce(parsed, 0) > 0 AS passed FROM orders LEFT JOIN f ON f.compound = o_orderkey LEFT JOIN p ON p.compound = o_orderkey""",
)
def compound_contract(spark, d):
    li = table(spark, d, "lineitem")
    cites = li.select(
        F.col("l_orderkey").alias("compound"),
        F.col("l_suppkey").alias("path"),
        (F.col("l_quantity") > 5).alias("resolved"),
        (~((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.09))).alias("grounded"),
    )
    parts = li.select(F.col("l_orderkey").alias("compound"), F.col("l_partkey").alias("id"))
    supplied = table(spark, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("id"))
    return grading.compound_contract(table(spark, d, "orders").select(F.col("o_orderkey").alias("compound")), cites, parts, supplied)


# Expectations of several checks, folded into one table per document.
@query(
    "expectations",
    """WITH e AS (SELECT doc_id AS case_id, n_chars <= 1000 AS a, n_chars >= 300 AS b, contains(text, '.') AS c FROM documents)
    SELECT case_id, CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT) AS passed, 3 - (CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT)) AS failed FROM e""",
)
def expectations(spark, d):
    a = artifacts(spark, d)
    meta = a.select("doc_id", tx.front_matter(F.col("text")).alias("meta"))
    numbers = grading.numeric_gate(meta, [("n_chars", "max", 1000), ("n_chars", "min", 300)]).select("doc_id", "passed")
    terms = grading.required_terms(table(spark, d, "documents"), ["[.]"]).select("doc_id", "passed")
    rows = numbers.unionByName(terms).withColumnRenamed("doc_id", "case_id")
    return grading.pass_rate(rows).select("case_id", "passed", "failed")


@query(
    "benchmark_absence",
    f"""WITH {DOCS}, {LINES}, b AS (SELECT DISTINCT {sql_norm('line')} AS line FROM (SELECT unnest({sql_lines('text')}) AS line FROM benchmark) WHERE length({sql_norm('line')}) >= 20)
    SELECT doc_id, count(*) AS hits FROM lines WHERE {sql_norm('line')} IN (SELECT line FROM b) GROUP BY doc_id""",
)
def benchmark_absence(spark, d):
    wanted = (
        table(spark, d, "benchmark")
        .select(F.explode(tx.lines(F.col("text"))).alias("line"))
        .select(tx.norm_ws(F.col("line")).alias("line"))
        .where(F.length("line") >= 20)
        .distinct()
    )
    have = doc_lines(spark, d).select("doc_id", tx.norm_ws(F.col("line")).alias("line"))
    return have.join(wanted, "line", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
