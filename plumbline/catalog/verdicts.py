"""Decision-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, sql_count, table
from plumbline.catalog.derived import DOCS, sized_docs
from plumbline.catalog.profile import PROFILE
from plumbline.functions import text as tx
from plumbline.operators import profile, verdicts


@query(
    "warrant",
    f"""WITH {DOCS}, {PROFILE}, m AS (SELECT {sql_count('text', '!!')} AS s FROM docs),
    x AS (SELECT (SELECT count(*) FROM docs, lim WHERE loc > threshold) >= 1 AS g, (SELECT count(*) FROM m WHERE s > 0) >= 2 OR (SELECT max(s) FROM m) >= 3 AS fp,
      (SELECT max(w) FROM (SELECT count(DISTINCT l_suppkey) AS w FROM lineitem GROUP BY l_partkey)) >= 2 AS s)
    SELECT (SELECT count(*) FROM docs) AS file_count, array_to_string(list_filter([CASE WHEN g THEN 'G' END, CASE WHEN s THEN 'S' END, CASE WHEN fp THEN 'Fp' END], lambda v: v IS NOT NULL), ',') AS live,
      'C' AS unmeasured, CASE WHEN (SELECT count(*) FROM docs) >= 100 THEN 'full' WHEN g OR s OR fp THEN 'selective' ELSE 'skip' END AS band FROM x""",
)
def warrant(spark, d):
    t = sized_docs(spark, d)
    row = lambda label, df, text: df.select(F.lit(label).alias("label"), text.alias("line"))
    big = row("godfile-candidates", profile.size_outliers(t), F.concat_ws("\t", "path", F.col("loc").cast("string")))
    swallowed = profile.marker_count(t, ["!!"])
    swallows = row("catch-swallows", swallowed, F.concat(F.col("path"), F.lit("\tswallows="), F.col("markers").cast("string")))
    owners = profile.write_ownership(
        table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("writer")), "part", "writer"
    )
    writes = row("write-sites", owners, F.concat(F.col("part").cast("string"), F.lit("\twriters="), F.col("writers").cast("string")))
    ran_empty = table(spark, d, "region").select(F.lit("low-cohesion").alias("label"), F.lit(None).cast("string").alias("line"))
    blocks = big.unionByName(swallows).unionByName(writes).unionByName(ran_empty)
    count = t.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = verdicts.warrant(blocks, count)
    return out.select("file_count", F.array_join("live", ",").alias("live"), F.array_join("unmeasured", ",").alias("unmeasured"), "band")


@query(
    "scorecard",
    f"""WITH {DOCS}, {PROFILE}, v AS (SELECT CAST(file_count AS DOUBLE) AS file_count, CAST(loc_median AS DOUBLE) AS loc_median, CAST((SELECT count(*) FROM docs, lim WHERE loc > threshold) AS DOUBLE) AS outliers FROM prof),
    l AS (SELECT 'file_count' AS signal, file_count AS value, 100.0 AS watch, 5000.0 AS hot FROM v UNION ALL SELECT 'loc_median', loc_median, 50.0, 200.0 FROM v UNION ALL SELECT 'outliers', outliers, 0.0, 10.0 FROM v)
    SELECT signal, value, CAST(watch AS DOUBLE) AS baseline, CASE WHEN value > hot THEN 'hot' WHEN value > watch THEN 'watch' ELSE 'ok' END AS verdict FROM l
    UNION ALL SELECT 'coverage', NULL, 80.0, 'n/a' UNION ALL SELECT 'composite', NULL, NULL, 'drifting'""",
)
def scorecard(spark, d):
    t = sized_docs(spark, d)
    outliers = profile.size_outliers(t).agg(F.count(F.lit(1)).alias("n")).scalar()
    metrics = profile.size_profile(t).withColumn("outliers", outliers).withColumn("coverage", F.lit(None).cast("double"))
    limits = {"file_count": (100, 5000), "loc_median": (50, 200), "outliers": (0, 10), "coverage": (80, 95)}
    return verdicts.scorecard(metrics, limits, "drifting")


@query(
    "priority_distribution",
    "SELECT o_orderpriority AS priority, count(*) AS cases, CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM orders) + 0.5) AS BIGINT) AS percentage FROM orders GROUP BY 1",
)
def priority_distribution(spark, d):
    return verdicts.priority_distribution(table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority")))


@query(
    "coverage_totals",
    """SELECT n_name AS portal, c_mktsegment AS feature, count(*) AS cases, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS smoke, CAST(sum(o_orderkey % 7 + 1) AS BIGINT) AS minutes
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (portal, feature) HAVING portal IS NOT NULL""",
)
def coverage_totals(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), (F.col("o_orderpriority") == "1-URGENT").alias("smoke"), (F.col("o_orderkey") % 7 + 1).alias("minutes")
    )
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("feature"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("portal"))
    return verdicts.coverage_totals(o.join(c, "c_custkey").join(n, "n_nationkey"), "portal", "feature", "minutes", "smoke")


@query(
    "test_density",
    f"""WITH c AS (SELECT doc_id, {sql_count('text', '[.]')} AS a, {sql_count('text', ',')} AS b FROM documents) SELECT doc_id, a, b, round(b / a, 6) AS ratio FROM c WHERE a > 0 AND b / a < 1""",
)
def test_density(spark, d):
    return profile.marker_density(table(spark, d, "documents"), "[.]", ",").select("doc_id", "a", "b", F.round("ratio", 6).alias("ratio"))


@query(
    "word_counts",
    "SELECT lang, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS BIGINT) AS n_words FROM documents GROUP BY lang",
)
def word_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(tx.words(F.col("text")))).alias("n_words"))
