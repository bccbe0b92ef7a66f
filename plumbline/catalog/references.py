"""Reference resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, sql_lines, table
from plumbline.catalog.derived import DOCS, FINDINGS, LINES, doc_lines, docs, findings
from plumbline.functions import text as tx
from plumbline.operators import references as ref

# Documents as script modules: d12 refers to ./d6, ../fr/d4, @/src1/en/d3 or an external name.
MODS = """mods AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || ['.ts', '.js', '/index.tsx', '.md'][doc_id % 4 + 1] AS path FROM documents),
specs AS (SELECT doc_id, path AS src, CASE doc_id % 5 WHEN 0 THEN './d' || (doc_id // 2) WHEN 1 THEN '../fr/d' || (doc_id // 3)
  WHEN 2 THEN '@/' || source_of || '/en/d' || (doc_id // 2) WHEN 3 THEN './d' || doc_id ELSE 'react' END AS spec
  FROM (SELECT m.*, string_split(m.path, '/')[1] AS source_of FROM mods m))"""


def script_modules(spark, d):
    n = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in (".ts", ".js", "/index.tsx", ".md")]), (n % 4 + 1).cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", "source", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), n.cast("string"), ending).alias("path")
    )


def script_specs(spark, d):
    n = F.col("doc_id")
    half, third = F.floor(n / 2).cast("string"), F.floor(n / 3).cast("string")
    spec = (
        F.when(n % 5 == 0, F.concat(F.lit("./d"), half))
        .when(n % 5 == 1, F.concat(F.lit("../fr/d"), third))
        .when(n % 5 == 2, F.concat(F.lit("@/"), F.col("source"), F.lit("/en/d"), half))
        .when(n % 5 == 3, F.concat(F.lit("./d"), n.cast("string")))
        .otherwise("react")
    )
    return script_modules(spark, d).select(F.col("path").alias("src"), spec.alias("spec"))


# The folder of 'a/b/index.tsx' is 'a/b/d7', so its relative paths start one level lower.
RESOLVED = f"""{MODS}, based AS (SELECT src, spec, CASE WHEN starts_with(spec, '@/') THEN substr(spec, 3)
    WHEN starts_with(spec, './') THEN regexp_replace(src, '/[^/]*$', '') || '/' || substr(spec, 3)
    WHEN starts_with(spec, '../') THEN regexp_replace(regexp_replace(src, '/[^/]*$', ''), '/[^/]*$', '') || '/' || substr(spec, 4) END AS base FROM specs),
suf AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.cts', '.mts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx',
    '/index.mjs', '/index.cjs', '/index.cts', '/index.mts']) AS s, unnest(range(17)) AS r),
found AS (SELECT src, spec, arg_min(m.path, r) AS dst FROM based JOIN suf ON true JOIN mods m ON m.path = base || s GROUP BY ALL),
resolved AS (SELECT based.src, based.spec, dst FROM based LEFT JOIN found USING (src, spec))"""


@query("resolve_reference", f"WITH {RESOLVED} SELECT * FROM resolved")
def resolve_reference(spark, d):
    return ref.resolve_reference(script_specs(spark, d), script_modules(spark, d))


@query("import_edges", f"WITH {RESOLVED} SELECT DISTINCT src, dst FROM resolved WHERE dst IS NOT NULL AND dst <> src")
def import_edges(spark, d):
    return ref.import_edges(resolve_reference(spark, d))


# Tokens of three shapes: a full path, a two-segment tail, a bare name.
TOKS = f"""{DOCS}, toks AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN './' || path
  WHEN 2 THEN lang || '/d' || (doc_id // 2) || '.md' ELSE 'd' || (doc_id * 3) || '.md' END AS tok FROM docs)"""


def cite_tokens(spark, d):
    n = F.col("doc_id")
    tok = (
        F.when(n % 4 == 0, F.col("path"))
        .when(n % 4 == 1, F.concat(F.lit("./"), F.col("path")))
        .when(n % 4 == 2, F.concat(F.col("lang"), F.lit("/d"), F.floor(n / 2).cast("string"), F.lit(".md")))
        .otherwise(F.concat(F.lit("d"), (n * 3).cast("string"), F.lit(".md")))
    )
    return docs(spark, d).select(tok.alias("tok"))


def both_editions(spark, d):
    """Every third document also exists in a second edition, so some names are ambiguous."""
    p = docs(spark, d).select("doc_id", "path")
    return p.select("path").unionByName(p.where("doc_id % 3 = 0").select(F.concat(F.lit("old/"), "path").alias("path")))


EDITIONS = "files AS (SELECT path FROM docs UNION ALL SELECT 'old/' || path FROM docs WHERE doc_id % 3 = 0)"


@query(
    "resolve_path",
    f"""WITH {TOKS}, {EDITIONS}, nt AS (SELECT tok, regexp_replace(tok, '^\\./', '') AS t FROM toks),
    h AS (SELECT tok, max(CASE WHEN path = t THEN path END) AS exact, count(CASE WHEN path <> t THEN 1 END) AS hits, min(CASE WHEN path <> t THEN path END) AS one
      FROM nt JOIN files ON path = t OR ends_with(path, '/' || t) GROUP BY tok)
    SELECT tok, CASE WHEN exact IS NOT NULL THEN exact WHEN hits = 1 THEN one END AS resolved,
      CASE WHEN exact IS NOT NULL OR hits = 1 THEN NULL WHEN hits > 1 THEN 'ambiguous: ' || hits || ' matches' ELSE 'no such file' END AS reason
    FROM toks LEFT JOIN h USING (tok)""",
)
def resolve_path(spark, d):
    return ref.resolve_path(cite_tokens(spark, d), both_editions(spark, d))


@query(
    "ambiguous_names",
    f"""WITH {TOKS}, {EDITIONS}, n AS (SELECT regexp_extract(path, '[^/]*$') AS tok, count(*) AS files FROM files GROUP BY 1)
    SELECT tok, files FROM toks JOIN n USING (tok) WHERE NOT contains(tok, '/') AND files >= 2""",
)
def ambiguous_names(spark, d):
    return ref.ambiguous_names(cite_tokens(spark, d), both_editions(spark, d))


@query(
    "lookup_near_path",
    f"""WITH {TOKS}, {EDITIONS}, x AS (SELECT tok, regexp_extract(tok, '[^/]*$') AS base, CASE WHEN contains(tok, '/') THEN regexp_replace(tok, '/[^/]*$', '') END AS frag FROM toks),
    h AS (SELECT tok, max(CASE WHEN path = tok THEN path END) AS exact, count(CASE WHEN ends_with(path, '/' || tok) THEN 1 END) AS nt, min(CASE WHEN ends_with(path, '/' || tok) THEN path END) AS tail,
        count(*) AS nb, min(path) AS b, count(CASE WHEN contains(path, frag || '/') THEN 1 END) AS nf, min(CASE WHEN contains(path, frag || '/') THEN path END) AS f
      FROM x JOIN files ON regexp_extract(path, '[^/]*$') = base GROUP BY tok),
    r AS (SELECT *, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN nt = 1 THEN 'suffix' WHEN nb = 1 THEN 'name' WHEN nf = 1 THEN 'name+folder' ELSE 'first' END AS how FROM h)
    SELECT tok, CASE how WHEN 'exact' THEN exact WHEN 'suffix' THEN tail WHEN 'name' THEN b WHEN 'name+folder' THEN f WHEN 'first' THEN coalesce(tail, b) END AS resolved, how
    FROM toks LEFT JOIN r USING (tok)""",
)
def lookup_near_path(spark, d):
    return ref.lookup_near_path(cite_tokens(spark, d), both_editions(spark, d))


@query(
    "longest_prefix_map",
    f"""WITH {DOCS}, px AS (SELECT DISTINCT source AS prefix, 'team ' || source AS owner FROM documents UNION SELECT DISTINCT source || '/' || lang, lang || ' team' FROM documents WHERE lang <> 'en'
      UNION SELECT source || '/' || lang || '/d' || doc_id || '.md:12', 'lead' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
    c AS (SELECT regexp_replace(prefix, '(\\.[^:]*):\\d+.*$', '\\1') AS prefix, min(owner) AS owner FROM px GROUP BY 1)
    SELECT doc_id, arg_max(owner, length(prefix)) AS owner, arg_max(prefix, length(prefix)) AS prefix FROM docs JOIN c ON path = prefix OR starts_with(path, prefix || '/') GROUP BY doc_id""",
)
def longest_prefix_map(spark, d):
    t = docs(spark, d).select("doc_id", "source", "lang", "path")
    marked = t.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    prefixes = (
        t.select(F.col("source").alias("prefix"), F.concat(F.lit("team "), "source").alias("owner"))
        .unionByName(t.where("lang <> 'en'").select(F.concat_ws("/", "source", "lang").alias("prefix"), F.concat("lang", F.lit(" team")).alias("owner")))
        .unionByName(marked.select(F.concat("path", F.lit(":12")).alias("prefix"), F.lit("lead").alias("owner")))
        .distinct()
    )
    return ref.longest_prefix_map(t.select("doc_id", "path"), prefixes).select("doc_id", "owner", "prefix")


NAMES = """defs AS (SELECT page_id AS doc, nullif(regexp_extract(html, '<h1>([A-Za-z]+)', 1), '') AS name FROM pages WHERE regexp_matches(html, '<h1>[A-Za-z]')),
refs AS (SELECT page_id AS doc, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)', 1)) AS name FROM pages)"""


def page_defs(spark, d):
    return (
        table(spark, d, "pages")
        .select(F.col("page_id").alias("doc"), F.regexp_extract("html", "<h1>([A-Za-z]+)", 1).alias("name"))
        .where(F.length("name") > 0)
    )


def page_refs(spark, d):
    return table(spark, d, "pages").select(
        F.col("page_id").alias("doc"), F.explode(tx.extract_tokens(F.col("html"), 'href="/([A-Za-z]+)')).alias("name")
    )


@query("dangling", f"WITH {NAMES} SELECT name, count(*) AS refs FROM refs WHERE name NOT IN (SELECT name FROM defs) GROUP BY name")
def dangling(spark, d):
    return ref.dangling(page_refs(spark, d), page_defs(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("refs"))


@query("orphans", f"WITH {NAMES} SELECT name, doc FROM defs WHERE name NOT IN (SELECT name FROM refs)")
def orphans(spark, d):
    return ref.orphans(page_defs(spark, d), page_refs(spark, d))


@query(
    "dead_definitions",
    f"WITH {NAMES} SELECT doc, name FROM defs WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.name = defs.name AND refs.doc <> defs.doc)",
)
def dead_definitions(spark, d):
    return ref.dead_definitions(page_defs(spark, d), page_refs(spark, d))


@query(
    "reference_tokens",
    f"""WITH l AS (SELECT doc_id, unnest({sql_lines('text')}) AS line FROM documents)
    SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(line, 'the ([a-z]+)', 1)) AS name FROM l WHERE NOT contains(line, 'and')) GROUP BY ALL""",
)
def reference_tokens(spark, d):
    return (
        ref.reference_tokens(table(spark, d, "documents"), "the ([a-z]+)", ignore="and")
        .groupBy("doc_id", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "unreferenced_modules",
    f"""WITH {RESOLVED} SELECT path FROM mods WHERE path NOT IN (SELECT dst FROM resolved WHERE dst IS NOT NULL AND dst <> src) AND doc_id % 10 <> 0""",
)
def unreferenced_modules(spark, d):
    m = script_modules(spark, d)
    return ref.unreferenced_modules(m.select("path"), import_edges(spark, d), m.where("doc_id % 10 = 0"))


# Orders as script text: each line is one member call on an imported or an own name.
CALLS = """calls AS (SELECT l_orderkey AS doc, CASE WHEN l_quantity < 25 THEN 'sup' || (l_suppkey % 3) ELSE 'own' || (l_partkey % 2) END AS name FROM lineitem),
cnt AS (SELECT doc, name, count(*) AS refs FROM calls GROUP BY ALL),
ext AS (SELECT doc, './' || name AS module, refs AS ext FROM cnt WHERE starts_with(name, 'sup')),
best AS (SELECT doc, module, ext FROM ext QUALIFY row_number() OVER (PARTITION BY doc ORDER BY ext DESC, module DESC) = 1),
own AS (SELECT doc, CAST(sum(refs) AS BIGINT) AS own FROM cnt WHERE starts_with(name, 'own') GROUP BY doc)"""


@query(
    "envy",
    f"""WITH {CALLS} SELECT CAST(best.doc AS VARCHAR) AS doc, module, ext, coalesce(own, 0) AS own, round(ext / greatest(ext + coalesce(own, 0), 1), 6) AS ratio
    FROM best LEFT JOIN own ON own.doc = best.doc WHERE ext >= 2 AND ext / greatest(ext + coalesce(own, 0), 1) >= 0.6 AND module <> './sup2'""",
)
def envy(spark, d):
    li = table(spark, d, "lineitem")
    name = F.when(F.col("l_quantity") < 25, F.concat(F.lit("sup"), (F.col("l_suppkey") % 3).cast("string"))).otherwise(
        F.concat(F.lit("own"), (F.col("l_partkey") % 2).cast("string"))
    )
    head = "import { sup0 } from './sup0';\nimport sup1 from './sup1'\nimport * as sup2 from './sup2'\nimport type { T } from './types'\n"
    body = F.array_join(F.collect_list(F.concat(name, F.lit(".go("))), "\n")
    # One text per order; an order has a handful of lines.
    texts = li.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.concat(F.lit(head), body).alias("text"))
    refs = ref.behavioural_refs(texts)
    bindings = ref.import_bindings(texts, doc="doc_id")
    own = texts.select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit("own0"), F.lit("own1"))).alias("name"))
    data_only = texts.select(F.col("doc_id").alias("doc"), F.lit("./sup2").alias("module"), F.lit(0).alias("behavioral"))
    return ref.envy(refs, bindings, own, data_only, min_refs=2).withColumn("ratio", F.round("ratio", 6))


@query(
    "citation_rate",
    f"""WITH {TOKS}, {EDITIONS}, {LINES}, c AS (SELECT source, CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN './' || path WHEN 2 THEN lang || '/d' || (doc_id // 2) || '.md' ELSE 'd' || (doc_id * 3) || '.md' END AS tok FROM docs),
    nt AS (SELECT source, regexp_replace(tok, '^\\./', '') AS t FROM c),
    r AS (SELECT source, t, (SELECT count(*) FROM files WHERE path = t) > 0 OR (SELECT count(*) FROM files WHERE ends_with(path, '/' || t)) = 1 AS ok FROM nt),
    g AS (SELECT source, count(*) AS checked, count(CASE WHEN ok THEN 1 END) AS resolvable FROM r GROUP BY source)
    SELECT source, checked, resolvable, CAST(floor(resolvable * 100.0 / checked + 0.5) AS BIGINT) AS rate, CAST(floor(resolvable * 100.0 / checked + 0.5) AS BIGINT) >= 60 AS passed FROM g""",
)
def citation_rate(spark, d):
    from plumbline.operators.grading import citation_rate as rate

    n = F.col("doc_id")
    tok = (
        F.when(n % 4 == 0, F.col("path"))
        .when(n % 4 == 1, F.concat(F.lit("./"), F.col("path")))
        .when(n % 4 == 2, F.concat(F.col("lang"), F.lit("/d"), F.floor(n / 2).cast("string"), F.lit(".md")))
        .otherwise(F.concat(F.lit("d"), (n * 3).cast("string"), F.lit(".md")))
    )
    cites = docs(spark, d).select("source", tok.alias("tok"))
    resolved = ref.resolve_path(cites, both_editions(spark, d)).select("tok", F.col("resolved").isNotNull().alias("ok"))
    return rate(cites.join(resolved, "tok"), doc="source", minimum=60)


@query(
    "ambiguous_evidence",
    f"""WITH {FINDINGS}, p AS (SELECT ev_path, count(*) AS n FROM findings GROUP BY ev_path) SELECT regexp_extract(ev_path, '[^/]*$') AS tok, count(*) AS files FROM p GROUP BY 1 HAVING count(*) >= 2""",
)
def ambiguous_evidence(spark, d):
    cited = findings(spark, d).select(F.explode("evidence").alias("e")).select(F.col("e.path").alias("path")).distinct()
    return ref.ambiguous_names(cited.select(F.substring_index("path", "/", -1).alias("tok")), cited)


@query(
    "line_table",
    f"WITH {DOCS}, {LINES} SELECT doc_id, count(*) AS n, max(line_no) AS last_line FROM lines GROUP BY doc_id",
)
def line_table(spark, d):
    return doc_lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last_line"))
