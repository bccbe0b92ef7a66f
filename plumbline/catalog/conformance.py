"""Declared-model queries: brands are elements, a part's folder is its path."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.catalog.derived import PART_EDGES, part_edges
from plumbline.operators import conformance as con
from plumbline.plans.lineage import materialize, scratch_path
from plumbline.sources import reports

# Elements: brands 10 and up belong to group 'far', the others to 'near'; brand 7 is undeclared.
ELEMENTS = """br AS (SELECT DISTINCT replace(p_brand, '#', '') AS folder, CAST(substr(p_brand, 7) AS INTEGER) AS k FROM part),
elem AS (SELECT CASE WHEN k >= 10 THEN 'far.' ELSE 'near.' END || lower(folder) AS fqn, folder FROM br WHERE k <> 7),
rel AS (SELECT 'near' AS src, 'far' AS dst UNION SELECT 'far.' || lower(x.folder), 'near.' || lower(y.folder) FROM br x JOIN br y ON x.k = y.k + 10
  UNION SELECT 'near.' || lower(x.folder), 'near.' || lower(x.folder) || '.x' FROM br x WHERE k < 10
  UNION SELECT 'near.' || lower(x.folder), 'far' FROM br x WHERE k < 10 AND k <> 7)"""


def elements(spark, d):
    k = F.substring("p_brand", 7, 10).cast("int")
    brands = table(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("folder"), k.alias("k")).distinct()
    fqn = F.concat(F.when(F.col("k") >= 10, "far.").otherwise("near."), F.lower("folder"))
    return brands, brands.where("k <> 7").select(fqn.alias("fqn"), F.array("folder").alias("prefixes"))


def relations(spark, d):
    brands, _ = elements(spark, d)
    far = brands.select((F.col("k") - 10).alias("j"), F.concat(F.lit("far."), F.lower("folder")).alias("src"))
    near = brands.select(F.col("k").alias("j"), F.concat(F.lit("near."), F.lower("folder")).alias("dst"))
    own = brands.where("k < 10").select(F.concat(F.lit("near."), F.lower("folder")).alias("src")).withColumn("dst", F.concat("src", F.lit(".x")))
    # Every near brand declares its own relation, which is nearer than the group's and takes all credit.
    single = brands.where("k < 10 AND k <> 7").select(F.concat(F.lit("near."), F.lower("folder")).alias("src"), F.lit("far").alias("dst"))
    groups = brands.where("k = 1").select(F.lit("near").alias("src"), F.lit("far").alias("dst"))
    return far.join(near, "j").select("src", "dst").unionByName(own).unionByName(single).unionByName(groups).withColumn("title", F.lit("uses"))


CREDIT = f"""{PART_EDGES}, {ELEMENTS}, mp AS (SELECT e.src, e.dst, a.fqn AS a, b.fqn AS b FROM edges e LEFT JOIN elem a ON a.folder = string_split(e.src, '/')[1] LEFT JOIN elem b ON b.folder = string_split(e.dst, '/')[1]),
prs AS (SELECT a, b, count(*) AS n FROM mp WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY a, b),
chn AS (SELECT a, b, n, s.i AS i, t.i AS j, CASE s.i WHEN 0 THEN a ELSE string_split(a, '.')[1] END AS src, CASE t.i WHEN 0 THEN b ELSE string_split(b, '.')[1] END AS dst
  FROM prs, (SELECT unnest([0, 1]) AS i) s, (SELECT unnest([0, 1]) AS i) t),
hit AS (SELECT a, b, arg_min(src || '>' || dst, i * 10 + j) AS c FROM chn JOIN rel USING (src, dst) GROUP BY a, b),
cred AS (SELECT prs.*, c FROM prs LEFT JOIN hit USING (a, b))"""


def _credits(spark, d):
    _, elems = elements(spark, d)
    prefixes = con.element_prefixes(elems)
    mapped = materialize(con.map_edges(materialize(part_edges(spark, d), "edges"), prefixes), "mapped")
    return mapped, prefixes, con.credited(con.owner_pairs(mapped), relations(spark, d))


@query("map_edges", f"WITH {CREDIT} SELECT a, b, count(*) AS n FROM mp GROUP BY a, b")
def map_edges(spark, d):
    _, elems = elements(spark, d)
    edges = materialize(part_edges(spark, d), "edges")
    return con.map_edges(edges, con.element_prefixes(elems)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("conformance", f"WITH {CREDIT} SELECT a, b, n, split_part(c, '>', 1) AS credit_src, split_part(c, '>', 2) AS credit_dst FROM cred")
def conformance(spark, d):
    return _credits(spark, d)[2].drop("sample")


@query("undocumented", f"WITH {CREDIT} SELECT a, b, n FROM cred WHERE c IS NULL")
def undocumented(spark, d):
    return con.undocumented(_credits(spark, d)[2]).drop("sample")


@query(
    "aspirational",
    f"""WITH {CREDIT}, backed AS (SELECT fqn AS x FROM elem UNION SELECT string_split(fqn, '.')[1] FROM elem)
    SELECT src, dst FROM rel WHERE src IN (SELECT x FROM backed) AND dst IN (SELECT x FROM backed) AND src || '>' || dst NOT IN (SELECT c FROM cred WHERE c IS NOT NULL)""",
)
def aspirational(spark, d):
    _, elems = elements(spark, d)
    prefixes = con.element_prefixes(elems)
    _, _, credits = _credits(spark, d)
    return con.aspirational(materialize(relations(spark, d), "relations"), credits, prefixes).drop("title")


@query(
    "conformance_gate",
    f"""WITH {CREDIT}, u AS (SELECT count(*) AS n FROM cred WHERE c IS NULL), m AS (SELECT count(DISTINCT p) AS n FROM (SELECT src AS p FROM mp WHERE a IS NULL UNION SELECT dst FROM mp WHERE b IS NULL))
    SELECT 'undocumented' AS measure, n AS value, CAST(0 AS BIGINT) AS maximum, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM u
    UNION ALL SELECT 'unmapped', n, 1000000, 'pass' FROM m""",
)
def conformance_gate(spark, d):
    _, elems = elements(spark, d)
    edges = materialize(part_edges(spark, d), "edges")
    summary = con.conformance_summary(edges, elems, relations(spark, d))
    return con.threshold_gate(summary, {"undocumented": 0, "unmapped": 1_000_000})


@query(
    "threshold_gate",
    """WITH c AS (SELECT count(*) AS n FROM documents WHERE contains(text, '!!')), l AS (SELECT count(*) AS n FROM documents WHERE contains(text, 'License'))
    SELECT 'shouting' AS measure, n AS value, CAST(5 AS BIGINT) AS maximum, CASE WHEN n > 5 THEN 'fail' ELSE 'pass' END AS verdict FROM c
    UNION ALL SELECT 'licenses', n, 100000, 'pass' FROM l UNION ALL SELECT 'unknown', NULL, 1, 'skip'""",
)
def threshold_gate(spark, d):
    t = table(spark, d, "documents")
    counts = t.agg(
        F.count(F.when(F.contains("text", F.lit("!!")), 1)).alias("shouting"),
        F.count(F.when(F.contains("text", F.lit("License")), 1)).alias("licenses"),
        F.max(F.lit(None).cast("bigint")).alias("unknown"),
    )
    return con.threshold_gate(counts, {"shouting": 5, "licenses": 100000, "unknown": 1})


@query(
    "layer_breaches",
    f"""WITH {PART_EDGES}, l AS (SELECT src, dst, CASE WHEN starts_with(src, 'Brand1/') OR starts_with(src, 'Brand2/') THEN 0 WHEN starts_with(src, 'Brand3/') THEN 1 WHEN starts_with(src, 'Brand4/') THEN 2 END AS a,
      CASE WHEN starts_with(dst, 'Brand1/') OR starts_with(dst, 'Brand2/') THEN 0 WHEN starts_with(dst, 'Brand3/') THEN 1 WHEN starts_with(dst, 'Brand4/') THEN 2 END AS b FROM edges)
    SELECT src, dst, 'no-upward-l' || a AS rule FROM l WHERE a > b UNION ALL SELECT src, dst, 'boundary-1' FROM l WHERE starts_with(src, 'Brand5/') AND starts_with(dst, 'Brand6/')""",
)
def layer_breaches(spark, d):
    return con.layer_breaches(
        part_edges(spark, d), [("base", ["Brand1", "Brand2"]), ("middle", ["Brand3"]), ("top", ["Brand4"])], [("Brand5", "Brand6")]
    )


SUPPLY = """steps AS (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS k, l_shipdate AS t FROM lineitem),
links AS (SELECT DISTINCT 'sup/' || x.s AS src, 'sup/' || y.s AS dst FROM steps x JOIN steps y ON x.o = y.o AND y.k = x.k + 1 WHERE y.t >= x.t),
reach AS (SELECT src, dst FROM links UNION SELECT r.src, e.dst FROM reach r JOIN links e ON e.src = r.dst)"""


def _supply_links(spark, d):
    """Suppliers of consecutive lines of an order that ship one after the other."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("t"))
    x = li.select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("s").alias("src"), F.col("t").alias("tx"))
    y = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("k"), F.col("s").alias("dst"), F.col("t").alias("ty"))
    links = x.join(y, ["l_orderkey", "k"]).where("ty >= tx").select("src", "dst").distinct()
    # Named after the lines have met, so that keys and not texts are sorted and compared.
    name = lambda end: F.concat(F.lit("sup/"), F.col(end).cast("string")).alias(end)
    return links.select(name("src"), name("dst"))


@query(
    "layer_breaches_circular",
    f"""WITH RECURSIVE {SUPPLY} SELECT src, dst, 'no-circular' AS rule FROM links l WHERE src = dst OR EXISTS (SELECT 1 FROM reach r WHERE r.src = l.dst AND r.dst = l.src)""",
)
def layer_breaches_circular(spark, d):
    return con.layer_breaches(_supply_links(spark, d), [], circular=True)


@query(
    "strongly_connected_all",
    f"""WITH RECURSIVE {SUPPLY}, m AS (SELECT a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src)
    SELECT node, max(other) AS scc FROM m GROUP BY node HAVING count(DISTINCT other) > 1""",
)
def strongly_connected_all(spark, d):
    """A general graph: every supplier has many ways in and out."""
    from plumbline.operators.graph import strongly_connected

    return strongly_connected(_supply_links(spark, d))


@query(
    "declared_model",
    """WITH s AS (SELECT s_suppkey, s_name, 'nation' || s_nationkey AS nation FROM supplier)
    SELECT nation || '.s' || s_suppkey AS fqn, CASE WHEN s_suppkey % 5 = 0 THEN 'moved/' || s_suppkey ELSE 'dir/' || s_suppkey || '|' || 'src/a' || s_suppkey || '|src/b' END AS prefixes,
      nation AS rel_src, nation || '.s' || s_suppkey AS rel_dst FROM s""",
)
def declared_model(spark, d):
    """A model file per nation, read with an override map for every fifth supplier."""
    key = F.col("s_suppkey").cast("string")
    fqn = F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit(".s"), key)
    meta = F.struct(F.concat(F.lit("./dir/"), key, F.lit("/")).alias("dir"), F.concat(F.lit("src/a"), key, F.lit("; src/b ")).alias("sources"))
    element = F.struct(fqn.alias("key"), F.struct(F.col("s_name").alias("title"), meta.alias("metadata")).alias("value"))
    relation = F.struct(
        F.struct(F.substring_index(fqn, ".", 1).alias("model")).alias("source"), F.struct(fqn.alias("id")).alias("target"), F.lit("owns").alias("title")
    )
    suppliers = table(spark, d, "supplier")
    models = suppliers.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(element)).alias("elements"), F.collect_list(relation).alias("relations"))
    path = scratch_path(spark, "models")
    models.select(F.to_json(F.struct("elements", "relations")).alias("value")).repartition(4).write.option("maxRecordsPerFile", 1).text(path)
    override = suppliers.where("s_suppkey % 5 = 0").select(fqn.alias("fqn"), F.array(F.concat(F.lit("./moved/"), key, F.lit("/"))).alias("prefixes"))
    elems, rels = reports.read_declared_model(spark, path, override)
    return elems.join(rels, elems["fqn"] == rels["dst"]).select(
        "fqn", F.array_join("prefixes", "|").alias("prefixes"), F.col("src").alias("rel_src"), F.col("dst").alias("rel_dst")
    )
