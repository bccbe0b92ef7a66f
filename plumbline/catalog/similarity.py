"""Near-duplicate and set-similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, sql_lines, sql_norm, table
from plumbline.catalog.text import HREF, sql_tokens
from plumbline.functions import text as tx
from plumbline.operators import similarity
from plumbline.plans.lineage import materialize

SEQ = f"""norm_lines AS (SELECT doc_id AS doc, unnest(range(1, len(l) + 1)) AS raw_no, unnest(l) AS line FROM (
    SELECT doc_id, list_transform({sql_lines('text')}, lambda x: {sql_norm('x')}) AS l FROM documents)),
kept AS (SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY raw_no) AS pos, count(*) OVER (PARTITION BY doc) AS n FROM norm_lines
  WHERE length(line) >= 12 AND NOT regexp_matches(line, '^(?:import\\b|export\\s+\\{{|export\\s+\\*|export\\s+type\\b|//|/\\*|\\*|@)')
    AND NOT regexp_matches(line, '^[A-Za-z_$][\\w$]*,?$') AND NOT regexp_matches(line, '^[)}}\\];,{{(]+$')),
seqs AS MATERIALIZED (SELECT doc, line, pos FROM kept WHERE n >= 8),
sets AS MATERIALIZED (SELECT DISTINCT doc, line FROM seqs),
sets_rep AS MATERIALIZED (SELECT doc, min(doc) OVER (PARTITION BY f) AS rep FROM (SELECT doc, list(line ORDER BY pos) AS f FROM seqs GROUP BY doc))"""

SKETCH = f"""toks AS (SELECT doc_id AS doc, {sql_tokens('text')} AS t FROM documents),
sk AS MATERIALIZED (SELECT doc, list_slice(list_sort(list_distinct(list_transform(range(1, len(t) - 7),
    lambda i: CAST('0x' || substr(md5(array_to_string(t[i:i + 8], ' ')), 1, 15) AS BIGINT)))), 1, 128) AS hashes FROM toks WHERE len(t) >= 120),
sketches AS MATERIALIZED (SELECT doc, unnest(hashes) AS h FROM sk),
sketches_rep AS MATERIALIZED (SELECT doc, min(doc) OVER (PARTITION BY hashes) AS rep FROM sk)"""


def _candidates(rel: str, key: str) -> str:
    """Pairs under the fan-out among different documents, and each copy with the first of its kind."""
    single = f"(SELECT * FROM {rel} WHERE doc IN (SELECT doc FROM {rel}_rep WHERE doc = rep))"
    return f"""SELECT DISTINCT x.doc AS a, y.doc AS b FROM {single} x JOIN {single} y ON x.{key} = y.{key} AND x.doc < y.doc
      WHERE x.{key} IN (SELECT {key} FROM {single} GROUP BY {key} HAVING count(*) BETWEEN 2 AND 6)
      UNION SELECT rep, doc FROM {rel}_rep WHERE rep < doc"""


@query("minhash_sketch", f"WITH {SKETCH} SELECT doc, CAST(len(hashes) AS BIGINT) AS n, list_min(hashes) AS lowest, list_max(hashes) AS highest FROM sk")
def minhash_sketch(spark, d):
    s = similarity.minhash_sketch(table(spark, d, "documents"), algorithm="md5")
    return s.select(
        "doc", F.size("hashes").cast("bigint").alias("n"), F.array_min("hashes").alias("lowest"), F.array_max("hashes").alias("highest")
    )


@query("candidate_pairs", f"WITH {SEQ} {_candidates('sets', 'line')}")
def candidate_pairs(spark, d):
    return similarity.candidate_pairs(materialize(similarity.line_sequences(table(spark, d, "documents")), "sequences"))


COPIES = """copied AS (SELECT doc_id * 10000 + unnest(range(CASE WHEN doc_id = 13 THEN 1000 WHEN doc_id = 11 THEN 40 WHEN doc_id % 40 = 7 THEN 7 ELSE 1 END)) AS doc_id, text FROM documents)"""


@query(
    "candidate_pairs_copies",
    f"WITH {COPIES}, {SEQ.replace('FROM documents', 'FROM copied')} {_candidates('sets', 'line')}",
)
def candidate_pairs_copies(spark, d):
    """All documents, some of them 7, 40 and 1000 times."""
    n = F.col("doc_id")
    times = F.when(n == 13, 1000).when(n == 11, 40).when(n % 40 == 7, 7).otherwise(1)
    copied = table(spark, d, "documents").select(n.alias("own"), F.explode(F.sequence(F.lit(0), times - 1)).alias("i"), "text")
    copied = copied.select((F.col("own") * 10000 + F.col("i")).alias("doc_id"), "text")
    return similarity.candidate_pairs(materialize(similarity.line_sequences(copied), "sequences"))


@query(
    "hash_groups",
    f"""WITH {SEQ} SELECT line_docs AS docs, count(*) AS lines, min(first_doc) AS first_doc FROM (SELECT line, count(*) AS line_docs, min(doc) AS first_doc
      FROM sets WHERE doc IN (SELECT doc FROM sets_rep WHERE doc = rep) GROUP BY line) WHERE line_docs > 6 GROUP BY line_docs""",
)
def hash_groups(spark, d):
    """Boilerplate lines by how many different documents hold them."""
    groups = similarity.hash_groups(materialize(similarity.line_sequences(table(spark, d, "documents")), "sequences"))
    return groups.where("docs > 6").groupBy("docs").agg(F.count(F.lit(1)).alias("lines"), F.min("first_doc").alias("first_doc"))


OVERLAP = f"""cand AS MATERIALIZED ({_candidates('sets', 'line')}),
sizes AS (SELECT doc, count(*) AS n FROM sets GROUP BY doc),
shared AS MATERIALIZED (SELECT a, b, count(*) AS shared FROM cand JOIN sets x ON x.doc = a JOIN sets y ON y.doc = b AND y.line = x.line GROUP BY ALL)"""


@query(
    "overlap",
    f"WITH {SEQ}, {OVERLAP} SELECT a, b, shared, round(shared / least(sa.n, sb.n), 6) AS overlap FROM shared JOIN sizes sa ON sa.doc = a JOIN sizes sb ON sb.doc = b",
)
def overlap(spark, d):
    seq = materialize(similarity.line_sequences(table(spark, d, "documents")), "sequences")
    return similarity.overlap(similarity.candidate_pairs(seq), seq).withColumn("overlap", F.round("overlap", 6))


@query(
    "sketch_jaccard",
    f"""WITH {SKETCH}, cand AS MATERIALIZED ({_candidates('sketches', 'h')}), i AS (SELECT a, b, count(*) AS n FROM cand JOIN sketches x ON x.doc = a JOIN sketches y ON y.doc = b AND y.h = x.h GROUP BY ALL)
    SELECT a, b, round(i.n / (len(p.hashes) + len(q.hashes) - i.n), 6) AS token_sim FROM i JOIN sk p ON p.doc = a JOIN sk q ON q.doc = b""",
)
def sketch_jaccard(spark, d):
    s = materialize(similarity.minhash_sketch(table(spark, d, "documents"), algorithm="md5"), "sketches")
    return similarity.sketch_jaccard(similarity.candidate_pairs(s), s).withColumn("token_sim", F.round("token_sim", 6))


RUNS = """hits AS (SELECT a, b, x.pos AS pa, x.pos - y.pos AS diag FROM shared JOIN seqs x ON x.doc = a JOIN seqs y ON y.doc = b AND y.line = x.line WHERE shared >= {min_run}),
islands AS (SELECT a, b, diag, pa - row_number() OVER (PARTITION BY a, b, diag ORDER BY pa) AS island FROM hits),
lengths AS (SELECT a, b, count(*) AS n FROM islands GROUP BY a, b, diag, island),
runs AS (SELECT a, b, max(n) AS run FROM lengths GROUP BY a, b)"""


@query("longest_common_run", f"WITH {SEQ}, {OVERLAP}, {RUNS.format(min_run=1)} SELECT a, b, run FROM runs")
def longest_common_run(spark, d):
    seq = materialize(similarity.line_sequences(table(spark, d, "documents")), "sequences")
    return similarity.longest_common_run(similarity.candidate_pairs(seq), seq)


FLAGGED = f"""{SEQ}, {SKETCH}, cand AS MATERIALIZED (SELECT a, b FROM ({_candidates('sets', 'line')}) UNION SELECT a, b FROM ({_candidates('sketches', 'h')})),
sizes AS (SELECT doc, count(*) AS n FROM sets GROUP BY doc),
shared AS MATERIALIZED (SELECT a, b, count(*) AS shared FROM cand JOIN sets x ON x.doc = a JOIN sets y ON y.doc = b AND y.line = x.line GROUP BY ALL),
inter AS (SELECT a, b, count(*) AS n FROM cand JOIN sketches x ON x.doc = a JOIN sketches y ON y.doc = b AND y.h = x.h GROUP BY ALL),
{RUNS.format(min_run=6)},
scored AS (SELECT a, b, coalesce(shared, 0) AS shared, coalesce(run, 0) AS run,
    coalesce(inter.n / (len(p.hashes) + len(q.hashes) - inter.n), 0.0) AS token_sim
  FROM cand LEFT JOIN shared USING (a, b) LEFT JOIN runs USING (a, b) LEFT JOIN inter USING (a, b) LEFT JOIN sk p ON p.doc = a LEFT JOIN sk q ON q.doc = b),
flagged AS MATERIALIZED (SELECT *, CASE WHEN run >= 6 AND token_sim >= 0.4 THEN 'both' WHEN token_sim >= 0.4 THEN 'structural' ELSE 'lines' END AS via
  FROM scored WHERE run >= 6 OR token_sim >= 0.4)"""


@query("duplicate_scores", f"WITH {FLAGGED} SELECT a, b, shared, run, round(token_sim, 6) AS token_sim, via FROM flagged")
def duplicate_scores(spark, d):
    return similarity.duplicate_scores(table(spark, d, "documents"), sketch_algorithm="md5").select(
        "a", "b", "shared", "run", F.round("token_sim", 6).alias("token_sim"), "via"
    )


@query(
    "duplicates",
    f"""WITH {FLAGGED} SELECT a, b, shared, run, round(token_sim, 6) AS token_sim, via FROM (
      SELECT * FROM (SELECT * FROM flagged WHERE via <> 'structural' ORDER BY run DESC, shared DESC, a, b LIMIT 12)
      UNION SELECT * FROM (SELECT * FROM flagged WHERE via <> 'lines' ORDER BY token_sim DESC, a, b LIMIT 12))""",
)
def duplicates(spark, d):
    flagged = similarity.duplicate_scores(table(spark, d, "documents"), sketch_algorithm="md5")
    return similarity.duplicates(materialize(flagged, "flagged")).select(
        "a", "b", "shared", "run", F.round("token_sim", 6).alias("token_sim"), "via"
    )


FIELDS = """recs AS (SELECT page_id AS rec, list_sort(list_distinct(list_concat(regexp_extract_all(html, '<([a-z0-9]+)', 1), regexp_extract_all(html, 'href="/([^"]+)"', 1)))) AS f FROM pages),
big AS (SELECT * FROM recs WHERE len(f) >= 8)"""


def _records(spark, d):
    html = F.col("html")
    fields = F.array_distinct(F.concat(tx.extract_tokens(html, "<([a-z0-9]+)"), tx.extract_tokens(html, 'href="/([^"]+)"')))
    return table(spark, d, "pages").select(F.col("page_id").alias("rec"), fields.alias("fields"))


@query(
    "projection_similarity",
    f"""WITH {FIELDS}, p AS (SELECT x.rec AS a, y.rec AS b, CAST(len(list_intersect(x.f, y.f)) AS BIGINT) AS shared, len(x.f) + len(y.f) AS total FROM big x JOIN big y ON x.rec < y.rec)
    SELECT a, b, shared, round(shared / (total - shared), 6) AS sim FROM p WHERE shared / (total - shared) >= 0.8 ORDER BY shared DESC, sim DESC, a, b LIMIT 20""",
)
def projection_similarity(spark, d):
    return similarity.projection_similarity(_records(spark, d), top=similarity.PROJECTION_ROWS).withColumn("sim", F.round("sim", 6))


@query(
    "projection_pairs",
    f"""WITH {FIELDS}, s AS (SELECT f, min(rec) AS shape FROM big GROUP BY f),
    p AS (SELECT x.shape AS a, y.shape AS b, CAST(len(list_intersect(x.f, y.f)) AS BIGINT) AS shared, len(x.f) + len(y.f) AS total FROM s x JOIN s y ON x.shape < y.shape)
    SELECT a, b, shared, round(shared / (total - shared), 6) AS sim FROM p WHERE shared / (total - shared) >= 0.8
    UNION ALL SELECT shape, rec, CAST(len(big.f) AS BIGINT), 1.0 FROM big JOIN s ON s.f = big.f WHERE rec <> shape""",
)
def projection_pairs(spark, d):
    return similarity.projection_similarity(_records(spark, d)).withColumn("sim", F.round("sim", 6))


@query(
    "shared_tokens",
    """WITH t AS (SELECT DISTINCT page_id AS doc, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS token FROM pages)
    SELECT token, count(*) AS docs, min(doc) AS first_doc, max(doc) AS last_doc FROM t WHERE token NOT IN ('/the', '/and') GROUP BY token HAVING count(*) > 1""",
)
def shared_tokens(spark, d):
    return similarity.shared_token_pairs(
        table(spark, d, "pages"), tx.extract_tokens(F.col("html"), HREF), doc="page_id", stop=["/the", "/and"]
    )


@query(
    "pairwise_disjoint",
    """WITH t AS (SELECT DISTINCT doc_id AS doc, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]{9,}'))) AS token FROM documents),
    s AS (SELECT token FROM t GROUP BY token HAVING count(*) > 1) SELECT count(*) = 0 AS disjoint, count(*) AS shared_tokens FROM s""",
)
def pairwise_disjoint(spark, d):
    return similarity.pairwise_disjoint(table(spark, d, "documents"), tx.extract_tokens(F.col("text"), "[A-Za-z0-9_]{9,}", 0))


@query(
    "peer_pairs",
    """WITH n AS (SELECT DISTINCT upper(substr(p_brand, 1, 1)) || 'x' || CASE p_size % 4 WHEN 0 THEN 'Service' WHEN 1 THEN 'Handler' WHEN 2 THEN 'Thing' ELSE 'Widget' END AS name FROM part WHERE p_type = 'ECONOMY'),
    e AS (SELECT DISTINCT 'Bx' || CASE p_size % 3 WHEN 0 THEN 'Service' WHEN 1 THEN 'Handler' ELSE 'Thing' END AS name FROM part
      UNION SELECT DISTINCT 'IBx' || CASE p_size % 3 WHEN 0 THEN 'Service' WHEN 1 THEN 'Handler' ELSE 'Thing' END FROM part
      UNION SELECT DISTINCT 'Other' || CASE p_size % 2 WHEN 0 THEN 'Service' ELSE 'Widget' END FROM part),
    p AS (SELECT name FROM e WHERE name NOT IN (SELECT name FROM n))
    SELECT n.name AS new_name, p.name AS peer_name, 'stem' AS rule, CAST(1 AS BIGINT) AS peers FROM n JOIN p ON contains(p.name, n.name) AND length(n.name) >= 0.6 * length(p.name)
    UNION ALL SELECT n.name, p.name, 'stem', 1 FROM n JOIN p ON p.name LIKE 'Other%' AND substr(p.name, 6) = substr(n.name, 3) AND length(n.name) - 2 >= 0.6 * length(p.name)
    UNION ALL SELECT n.name, p.name, 'interface', 1 FROM n JOIN p ON p.name = 'I' || n.name
    UNION ALL SELECT n.name, NULL, 'role', (SELECT count(*) FROM p WHERE ends_with(p.name, substr(n.name, 3))) FROM n
      WHERE substr(n.name, 3) IN ('Service', 'Handler') AND EXISTS (SELECT 1 FROM p WHERE ends_with(p.name, substr(n.name, 3)))""",
)
def peer_pairs(spark, d):
    part = table(spark, d, "part")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_size") % n + 1).cast("int"))
    new = part.where("p_type = 'ECONOMY'").select(
        F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lit("x"), pick(4, "Service", "Handler", "Thing", "Widget")).alias("name")
    )
    third = pick(3, "Service", "Handler", "Thing")
    existing = part.select(
        F.explode(F.array(F.concat(F.lit("Bx"), third), F.concat(F.lit("IBx"), third), F.concat(F.lit("Other"), pick(2, "Service", "Widget")))).alias("name")
    )
    return similarity.peer_pairs(new, existing).select("new_name", "peer_name", "rule", "peers")
