"""Corpus profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import pct_sql, query, sql_count, sql_lines, table
from plumbline.catalog.derived import DOCS, docs, sized_docs
from plumbline.functions import text as tx
from plumbline.operators import profile, quality

PROFILE = """prof AS (
  SELECT count(*) AS file_count, CAST(sum(loc) AS BIGINT) AS loc_total,
    CAST(floor(quantile_cont(loc, 0.5) + 0.5) AS BIGINT) AS loc_median, CAST(floor(quantile_cont(loc, 0.9) + 0.5) AS BIGINT) AS loc_p90 FROM docs),
lim AS (SELECT *, CASE WHEN loc_median = 0 THEN 1 ELSE loc_median END AS median,
  greatest(3 * CASE WHEN loc_median = 0 THEN 1 ELSE loc_median END, CAST(floor(1.5 * loc_p90 + 0.5) AS BIGINT)) AS threshold FROM prof)"""


@query("size_profile", f"WITH {DOCS}, {PROFILE} SELECT * FROM prof")
def size_profile(spark, d):
    return profile.size_profile(sized_docs(spark, d))


@query(
    "size_outliers",
    f"""WITH {DOCS}, {PROFILE} SELECT doc_id, path, loc, round(loc / median, 1) AS ratio FROM docs, lim WHERE loc > threshold""",
)
def size_outliers(spark, d):
    return profile.size_outliers(sized_docs(spark, d).select("doc_id", "path", "loc"))


@query(
    "marker_count",
    f"SELECT doc_id, {sql_count('text', '!!')} + {sql_count('text', '[0-9]+')} AS markers FROM documents WHERE {sql_count('text', '!!')} + {sql_count('text', '[0-9]+')} > 0",
)
def marker_count(spark, d):
    return profile.marker_count(table(spark, d, "documents").select("doc_id", "text"), ["!!", "[0-9]+"]).select("doc_id", "markers")


@query(
    "marker_density",
    f"""WITH c AS (SELECT page_id, {sql_count('html', '<p>')} AS a, {sql_count('html', '<b>')} AS b FROM pages)
    SELECT page_id, a, b, round(b / a, 6) AS ratio FROM c WHERE a > 0 AND b / a < 0.5""",
)
def marker_density(spark, d):
    return profile.marker_density(table(spark, d, "pages"), "<p>", "<b>", "html", 0.5).select(
        "page_id", "a", "b", F.round("ratio", 6).alias("ratio")
    )


@query(
    "write_ownership",
    "SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS writers, count(DISTINCT l_suppkey) >= 2 AS scattered FROM lineitem GROUP BY l_partkey",
)
def write_ownership(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("writer"))
    return profile.write_ownership(li, "part", "writer")


@query(
    "ownership_members",
    """SELECT DISTINCT l_partkey AS part, l_suppkey AS writer FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 25)""",
)
def ownership_members(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("writer"))
    return profile.ownership_members(li, "part", "writer", min_writers=25)


@query(
    "nearest_preceding",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS pos, event_type FROM events),
    m AS (SELECT user_id, pos, min(event_id) AS label FROM e WHERE event_type = 'signup' GROUP BY ALL)
    SELECT c.event_id, c.user_id, CASE WHEN c.pos - m.pos < 21600 THEN m.label END AS label
    FROM (SELECT * FROM e WHERE event_type = 'purchase') c ASOF LEFT JOIN m ON c.user_id = m.user_id AND c.pos > m.pos""",
)
def nearest_preceding(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos")
    )
    markers = e.where("event_type = 'signup'").groupBy("user_id", "pos").agg(F.min("event_id").alias("label"))
    calls = e.where("event_type = 'purchase'").select("event_id", "user_id", "pos")
    return profile.nearest_preceding(markers, calls, ["user_id"], "pos", "label", 21600).select("event_id", "user_id", "label")


@query(
    "write_sites",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS k, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL),
    s AS (SELECT 'table:' || CASE (SELECT max(m.k) FROM l m WHERE m.l_orderkey = l.l_orderkey AND m.k < l.k AND m.k % 4 IN (0, 1)) % 4
        WHEN 1 THEN 'brand' WHEN 0 THEN 'sup' || (SELECT arg_max(m.l_suppkey, m.k) FROM l m WHERE m.l_orderkey = l.l_orderkey AND m.k < l.k AND m.k % 4 IN (0, 1)) END AS site,
        l_orderkey FROM l WHERE k % 4 = 2
      UNION SELECT 'rpc:fn' || (l_partkey % 10), l_orderkey FROM l WHERE k % 4 = 3)
    SELECT site, count(DISTINCT l_orderkey) AS writers FROM s WHERE site IS NOT NULL GROUP BY site""",
)
def write_sites(spark, d):
    k = F.col("l_linenumber")
    piece = (
        F.when(k % 4 == 0, F.concat(F.lit('.from("sup'), F.col("l_suppkey").cast("string"), F.lit('").select()')))
        .when(k % 4 == 1, F.lit('const T = "brand"; db.from(T)'))
        .when(k % 4 == 2, F.lit(".insert(x)"))
        .otherwise(F.concat(F.lit('.rpc("fn'), (F.col("l_partkey") % 10).cast("string"), F.lit('")')))
    )
    # An order has at most a handful of lines, so its text is bounded.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey")
    )
    code = lines.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, piece.alias("p")))), lambda s: s["p"]), " ").alias("text")
    )
    # Repeated constants of one text carry the same value; the sites are distinct per text.
    return profile.write_sites(code).groupBy("site").agg(F.count(F.lit(1)).alias("writers"))


STEM = "regexp_extract(html, '<h1>([A-Za-z]+)', 1)"


@query(
    "usage",
    f"""WITH t AS (SELECT page_id, {sql_count('html', '<p>')} AS declared, nullif({STEM}, '') AS stem,
        list_distinct(regexp_extract_all(html, '[A-Za-z0-9_]+')) AS words FROM pages),
    w AS (SELECT * FROM t WHERE declared >= 5),
    m AS (SELECT page_id, unnest(words) AS stem FROM t)
    SELECT w.page_id, declared, w.stem, CASE WHEN w.stem IS NOT NULL THEN (SELECT count(*) FROM m WHERE m.stem = w.stem AND m.page_id <> w.page_id) END AS inbound FROM w""",
)
def usage(spark, d):
    html = F.col("html")
    stem = F.nullif(F.regexp_extract(html, "<h1>([A-Za-z]+)", 1), F.lit(""))
    return profile.usage(table(spark, d, "pages"), tx.count_matches(html, "<p>"), stem, tx.words(html), doc="page_id")


@query(
    "usage_by_text",
    f"""WITH t AS (SELECT page_id, {sql_count('html', '<p>')} AS declared, nullif({STEM}, '') AS stem FROM pages),
    w AS (SELECT * FROM t WHERE declared >= 5)
    SELECT w.page_id, declared, stem, CASE WHEN stem IS NOT NULL THEN (SELECT count(*) FROM pages p WHERE contains(p.html, w.stem) AND p.page_id <> w.page_id) END AS inbound FROM w""",
)
def usage_by_text(spark, d):
    html = F.col("html")
    stem = F.nullif(F.regexp_extract(html, "<h1>([A-Za-z]+)", 1), F.lit(""))
    pages = table(spark, d, "pages")
    wanted = (
        pages.select("page_id", tx.count_matches(html, "<p>").alias("declared"), stem.alias("stem"))
        .where(F.col("declared") >= 5)
    )
    return profile.usage_by_text(pages, wanted, doc="page_id", text="html")


@query(
    "unpaired",
    """SELECT tok, n FROM (SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS tok FROM documents) GROUP BY tok) WHERE n < 2""",
)
def unpaired(spark, d):
    return profile.unpaired(
        table(spark, d, "documents").select(F.explode(tx.extract_tokens(F.col("text"), "[A-Z][a-z]+", 0)).alias("tok")), ["tok"]
    )


@query(
    "shape_conflicts",
    """WITH t AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS name,
        list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))) AS f FROM pages),
    s AS (SELECT name, array_to_string(f, ';') AS sig FROM t WHERE len(f) >= 3), c AS (SELECT name, sig, count(*) AS n FROM s GROUP BY ALL)
    SELECT 'drift' AS kind, name AS label, CAST(sum(n) AS BIGINT) AS defs, count(*) AS variants FROM c GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'same-shape', sig, CAST(sum(n) AS BIGINT), count(*) FROM c GROUP BY sig HAVING count(*) > 1""",
)
def shape_conflicts(spark, d):
    decls = table(spark, d, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("name"),
        F.array_distinct(tx.extract_tokens(F.col("html"), "<([a-z0-9]+)")).alias("fields"),
    )
    return profile.shape_conflicts(decls)


@query(
    "prefix_cluster",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
    u AS (SELECT page_id, path, unnest(range(1, len(string_split(path, '/')))) AS depth FROM p),
    x AS (SELECT page_id, path, depth, array_to_string(string_split(path, '/')[1:depth], '/') AS prefix FROM u),
    c AS (SELECT prefix, count(*) AS members FROM x GROUP BY prefix HAVING count(*) >= 2),
    b AS (SELECT x.page_id, arg_max(x.prefix, depth) AS cluster, arg_max(members, depth) AS members FROM x JOIN c USING (prefix) GROUP BY x.page_id)
    SELECT p.page_id, p.path, coalesce(b.cluster, p.path) AS cluster, coalesce(b.members, 1) AS members FROM p LEFT JOIN b USING (page_id)""",
)
def prefix_cluster(spark, d):
    p = table(spark, d, "pages").select(
        "page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path")
    )
    return profile.prefix_cluster(p).withColumn("members", F.col("members").cast("bigint"))


COVER = """hits AS (SELECT l_suppkey AS path, 'stmt' AS kind, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS hit FROM lineitem
  UNION ALL SELECT l_suppkey, 'branch', CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END FROM lineitem
  UNION ALL SELECT l_suppkey, 'fn', CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END FROM lineitem)"""


def _cov(kind: str) -> str:
    covered = f"count(CASE WHEN kind = '{kind}' AND hit > 0 THEN 1 END)"
    return pct_sql(covered, f"count(CASE WHEN kind = '{kind}' THEN 1 END)") + f" AS {kind}"


@query(
    "coverage_rollup",
    f"WITH {COVER} SELECT path, {_cov('stmt')}, {_cov('branch')}, {_cov('fn')} FROM hits GROUP BY ROLLUP (path)",
)
def coverage_rollup(spark, d):
    li = table(spark, d, "lineitem")
    one = lambda kind, cond: F.struct(F.lit(kind).alias("kind"), cond.cast("int").alias("hit"))
    hits = li.select(
        F.col("l_suppkey").alias("path"),
        F.explode(
            F.array(
                one("stmt", F.col("l_quantity") > 10), one("branch", F.col("l_returnflag") == "N"), one("fn", F.col("l_discount") > 0.05)
            )
        ).alias("h"),
    ).select("path", "h.*")
    return quality.coverage_rollup(hits)


MUTANTS = """mutants AS (SELECT p_brand AS path, CASE l_returnflag WHEN 'R' THEN 'Killed' WHEN 'A' THEN 'Survived'
  ELSE CASE WHEN l_linestatus = 'O' AND l_quantity > 40 THEN 'NoCoverage' WHEN l_quantity < 3 THEN 'Timeout' ELSE 'CompileError' END END AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def mutants(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    status = (
        F.when(F.col("l_returnflag") == "R", "Killed")
        .when(F.col("l_returnflag") == "A", "Survived")
        .when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), "NoCoverage")
        .when(F.col("l_quantity") < 3, "Timeout")
        .otherwise("CompileError")
    )
    return li.join(part, "l_partkey").select("path", status.alias("status"))


@query(
    "mutation_score",
    f"""WITH {MUTANTS}, c AS (SELECT path, count(CASE WHEN status = 'Killed' THEN 1 END) AS killed, count(CASE WHEN status = 'Survived' THEN 1 END) AS survived,
      count(CASE WHEN status = 'NoCoverage' THEN 1 END) AS no_coverage, count(CASE WHEN status = 'Timeout' THEN 1 END) AS timeout FROM mutants GROUP BY path),
    r AS (SELECT path, CAST(sum(killed) AS BIGINT) AS killed, CAST(sum(survived) AS BIGINT) AS survived, CAST(sum(no_coverage) AS BIGINT) AS no_coverage,
      CAST(sum(timeout) AS BIGINT) AS timeout FROM c WHERE killed + survived + no_coverage + timeout > 0 GROUP BY ROLLUP (path))
    SELECT *, CASE WHEN killed + survived > 0 THEN CAST(floor(killed * 100.0 / (killed + survived) + 0.5) AS BIGINT) ELSE 0 END AS score FROM r""",
)
def mutation_score(spark, d):
    return quality.mutation_score(mutants(spark, d))


@query(
    "report_scope",
    """WITH t AS (SELECT doc_id FROM documents WHERE source = 'src1'),
    r AS (SELECT DISTINCT doc_id FROM labels)
    SELECT (SELECT count(*) FROM t) AS target_has, (SELECT count(*) FROM t JOIN r USING (doc_id)) AS report_covers,
      (SELECT count(*) FROM t) - (SELECT count(*) FROM t JOIN r USING (doc_id)) AS missing,
      CASE WHEN (SELECT count(*) FROM r JOIN documents USING (doc_id) WHERE source <> 'src1') >= 3 THEN 'full' ELSE 'partial' END AS scope""",
)
def report_scope(spark, d):
    all_docs = docs(spark, d).select("doc_id", "path", "source")
    reported = all_docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return quality.report_scope(all_docs.where("source = 'src1'"), reported, target="src1")


@query(
    "theater_matrix",
    f"""WITH {COVER}, cov AS (SELECT path, {_cov('stmt')}, {_cov('branch')} FROM hits GROUP BY path),
    den AS (SELECT l_suppkey AS path, sum(l_tax) / sum(l_discount) AS ratio FROM lineitem GROUP BY l_suppkey),
    mut AS (SELECT s_suppkey AS path, CASE WHEN s_acctbal > 1000 THEN CAST(s_acctbal / 100 AS BIGINT) END AS score FROM supplier),
    j AS (SELECT coalesce(cov.path, den.path, mut.path) AS path, ratio, stmt, branch, score FROM den FULL JOIN cov ON den.path = cov.path FULL JOIN mut ON mut.path = coalesce(cov.path, den.path))
    SELECT path, CASE WHEN coalesce(stmt, 0) > 0 AND branch = 0 THEN 'coverage gap' WHEN coalesce(stmt, 0) > 0 AND coalesce(ratio, 0) < 0.8 THEN 'theater'
      WHEN coalesce(stmt, 0) > 0 AND score IS NULL THEN 'unknown' WHEN coalesce(stmt, 0) > 0 AND score < 40 THEN 'definitive theater'
      WHEN coalesce(stmt, 0) > 0 THEN 'real' WHEN coalesce(ratio, 0) >= 0.8 THEN 'mock theater' ELSE 'untested' END AS verdict FROM j""",
)
def theater_matrix(spark, d):
    li = table(spark, d, "lineitem")
    cov = coverage_rollup(spark, d).where(F.col("path").isNotNull())
    density = (
        li.groupBy(F.col("l_suppkey").alias("path"))
        .agg((F.sum("l_tax") / F.sum("l_discount")).alias("ratio"))
    )
    # Suppliers without a score have a report that says nothing.
    score = F.when(F.col("s_acctbal") > 1000, F.round(F.col("s_acctbal") / 100).cast("bigint")).alias("score")
    mut = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), score)
    return quality.theater_matrix(density, cov, mut, scope="partial", asserted_at=0.8).select("path", "verdict")


@query(
    "load_table",
    f"SELECT lang, CAST(sum(len({sql_lines('text')})) AS BIGINT) AS n_lines, count(*) AS n_docs FROM documents GROUP BY lang",
)
def load_table_scan(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.sum(F.size(tx.lines(F.col("text")))).alias("n_lines"), F.count(F.lit(1)).alias("n_docs")
    )
