"""Findings lifecycle queries on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, sql_fingerprint, sql_fp_norm, sql_trim, table
from plumbline.catalog.derived import FINDINGS, findings
from plumbline.operators import findings as fnd
from plumbline.plans.lineage import materialize, scratch_path
from plumbline.sources import findings as intake
from plumbline.sources import sarif

ERRORS = f"""errs AS (
  SELECT id, 'taken' AS code, 'id' AS field, id AS value FROM findings WHERE status = 'rejected'
  UNION ALL SELECT id, 'empty', 'why', NULL FROM findings WHERE kind = 'ar' AND why IS NULL
  UNION ALL SELECT id, 'not_allowed', 'verify', NULL FROM findings WHERE kind = 'ar' AND verify IS NULL
  UNION ALL SELECT id, 'absent', 'remediation', NULL FROM findings WHERE kind = 'ar' AND NOT has_remediation
  UNION ALL SELECT id, 'empty', 'why', severity FROM findings WHERE kind = 'dr' AND severity IN ('critical', 'important', 'discuss') AND why IS NULL
  UNION ALL SELECT id, 'empty', 'fix', severity FROM findings WHERE kind = 'dr' AND severity IN ('critical', 'important', 'suggestion') AND fix IS NULL
  UNION ALL SELECT id, 'out_of_range', 'evidence[0].endLine', CAST(ev_end AS VARCHAR) FROM findings WHERE ev_end IS NOT NULL
  UNION ALL SELECT id, 'empty_list', 'evidence[0].quoted', NULL FROM findings WHERE len(list_filter(quoted, lambda q: length({sql_trim('q')}) = 0)) > 0)"""


@query("validate_records", f"WITH {FINDINGS}, {ERRORS} SELECT id, code, field, value FROM errs")
def validate_records(spark, d):
    f = findings(spark, d)
    known = f.where("status = 'rejected'").select("id")
    return fnd.validate_records(f, known_ids=known).select("id", F.explode("errors").alias("e")).select("id", "e.*")


@query(
    "unknown_keys",
    f"""WITH {FINDINGS}, {ERRORS} SELECT id, code, field, value FROM errs WHERE code <> 'taken'
    UNION ALL SELECT id, 'unknown', 'extra' || (n % 3), NULL FROM findings WHERE n % 6 = 0""",
)
def unknown_keys(spark, d):
    """Records from raw lines; every sixth carries a key the schema doesn't know."""
    f = findings(spark, d).drop("fp")
    n = F.substring("id", 2, 20).cast("bigint")
    key = F.concat(F.lit(',"extra'), (n % 3).cast("string"), F.lit('":1}'))
    line = F.to_json(F.struct(*f.columns))
    raw = f.select(F.when(n % 6 == 0, F.concat(F.substring(line, F.lit(1), F.length(line) - 1), key)).otherwise(line).alias("value"))
    landing = scratch_path(spark, "lines")
    raw.write.text(landing)
    return fnd.validate_records(intake.read_records(spark.read.text(landing)), unknown_keys="unknown_keys").select("id", F.explode("errors").alias("e")).select("id", "e.*")


@query(
    "append_findings",
    f"""WITH {FINDINGS}, {ERRORS} SELECT id, fp, status FROM findings WHERE id NOT IN (SELECT id FROM errs WHERE code <> 'taken')""",
)
def append_findings(spark, d):
    stored, refused = scratch_path(spark, "findings"), scratch_path(spark, "refused")
    f = fnd.validate_records(findings(spark, d).drop("fp"))
    good = f.where(F.size("errors") == 0).drop("errors")
    good = materialize(good, "good")
    intake.append_findings(good.withColumn("fp", F.lit(None).cast("string")), stored, refused)
    # The same ids again: the whole batch must be refused and the table stay as it is.
    intake.append_findings(good.where("status = 'open'").withColumn("fp", F.lit(None).cast("string")), stored, refused)
    return spark.read.parquet(stored).select("id", "fp", "status")


NDJSON = f"""WITH {FINDINGS}, l AS (SELECT n, id, CASE WHEN n % 19 = 0 THEN NULL ELSE lens END AS lens, CASE WHEN n % 23 = 0 THEN CAST([] AS VARCHAR[]) ELSE quoted END AS quoted, symbol FROM findings)
SELECT CASE WHEN n % 29 = 0 THEN NULL ELSE id END AS id,
  CASE WHEN n % 29 <> 0 AND lens IS NOT NULL AND len(list_filter(quoted, lambda q: length({sql_fp_norm('q')}) > 0)) > 0 THEN {sql_fingerprint('lens', 'quoted', 'symbol')} END AS fp,
  CASE WHEN n % 29 = 0 THEN 'not_json' WHEN lens IS NULL THEN 'lens_empty' WHEN len(quoted) = 0 THEN 'quoted_empty'
    WHEN len(list_filter(quoted, lambda q: length({sql_fp_norm('q')}) > 0)) = 0 THEN 'quoted_blank' END AS error FROM l"""


def ndjson_lines(spark, d):
    n = F.substring("id", 2, 20).cast("bigint")
    f = findings(spark, d).select(
        n.alias("n"), "id", F.when(n % 19 != 0, F.col("lens")).alias("lens"), F.element_at("evidence", 1)["quoted"].alias("quoted"), "symbol"
    )
    quoted = F.when(F.col("n") % 23 == 0, F.array().cast("array<string>")).otherwise(F.col("quoted"))
    record = F.to_json(F.struct("id", "lens", quoted.alias("quoted"), "symbol"))
    return f.select(F.when(F.col("n") % 29 == 0, F.concat(F.lit("broken "), record)).otherwise(record).alias("value"))


@query("read_findings_ndjson", NDJSON)
def read_findings_ndjson(spark, d):
    path = scratch_path(spark, "ndjson")
    ndjson_lines(spark, d).write.text(path)
    return intake.read_findings_ndjson(spark, path).select("id", "fp", "error")


def verdicts(spark, d):
    """A verdict per finding; some lack the note they need."""
    n = F.substring("id", 2, 20).cast("bigint")
    return findings(spark, d).where("verify IS NOT NULL").select(
        "id", F.col("verify").alias("verdict"), F.when(n % 8 != 3, F.lit(" narrower than stated ")).alias("note")
    )


@query(
    "demote",
    f"""WITH {FINDINGS}, v AS (SELECT *, CASE WHEN verify IS NULL THEN NULL WHEN verify IN ('Weakened', 'Falsified') AND n % 8 = 3 THEN 'verdict requires a note'
      WHEN verify = 'Weakened' AND kind = 'dr' AND severity = 'critical' AND (why IS NULL) THEN 'lower tier requires a why'
      WHEN verify = 'Weakened' AND kind = 'dr' AND severity = 'suggestion' AND (why IS NULL) THEN 'lower tier requires a why'
      WHEN verify = 'Weakened' AND kind = 'dr' AND severity IN ('critical', 'important') AND (fix IS NULL) THEN 'lower tier requires a fix' END AS err FROM findings)
    SELECT id, CASE WHEN verify = 'Weakened' AND err IS NULL THEN CASE severity WHEN 'High' THEN 'Med' WHEN 'Med' THEN 'Low' WHEN 'critical' THEN 'important'
        WHEN 'important' THEN 'suggestion' WHEN 'suggestion' THEN 'discuss' ELSE severity END ELSE severity END AS severity,
      CASE WHEN verify = 'Falsified' AND err IS NULL THEN 'withdrawn' ELSE status END AS status, err AS update_error FROM v""",
)
def demote(spark, d):
    return fnd.demote(findings(spark, d), verdicts(spark, d)).select("id", "severity", "status", "update_error")


SNAPSHOTS = f"""{FINDINGS}, cur AS (SELECT id, title, fp FROM findings WHERE n % 3 <> 0), pri AS (SELECT 'P' || n AS id, title, fp FROM findings WHERE n % 4 IN (0, 1)),
res AS (SELECT 'R' || n AS id, title, fp FROM findings WHERE n % 4 = 2),
pa AS (SELECT fp, max(id) AS id FROM pri GROUP BY fp), ra AS (SELECT fp, max(id) AS id FROM res GROUP BY fp),
drifted AS (SELECT cur.id, cur.fp, CASE WHEN pa.id IS NOT NULL THEN 'Still-open' WHEN ra.id IS NOT NULL THEN 'Regressed' ELSE 'NEW' END AS drift_class,
    CASE WHEN pa.id IS NOT NULL THEN 'unchanged' ELSE 'new' END AS baseline_state, coalesce(pa.id, ra.id) AS prior_id
  FROM cur LEFT JOIN pa ON pa.fp = cur.fp LEFT JOIN ra ON ra.fp = cur.fp
  UNION ALL SELECT id, fp, 'Resolved', 'absent', id FROM pri WHERE fp NOT IN (SELECT fp FROM cur))"""


def _drift(spark, d):
    n = F.substring("id", 2, 20).cast("bigint")
    f = materialize(findings(spark, d).select("id", "title", "fp", n.alias("n")), "findings")
    renamed = lambda cond, mark: f.where(cond).select(F.concat(F.lit(mark), F.col("n").cast("string")).alias("id"), "title", "fp")
    return fnd.drift(f.where("n % 3 <> 0").select("id", "title", "fp"), renamed("n % 4 IN (0, 1)", "P"), renamed("n % 4 = 2", "R"))


@query("drift", f"WITH {SNAPSHOTS} SELECT * FROM drifted")
def drift(spark, d):
    return _drift(spark, d).drop("title")


@query(
    "drift_counts",
    f"""WITH {SNAPSHOTS}, c AS (SELECT count(CASE WHEN drift_class = 'NEW' THEN 1 END) AS new, count(CASE WHEN drift_class = 'Still-open' THEN 1 END) AS still_open,
      count(CASE WHEN drift_class = 'Regressed' THEN 1 END) AS regressed, count(CASE WHEN drift_class = 'Resolved' THEN 1 END) AS resolved FROM drifted) SELECT *, new - resolved AS net FROM c""",
)
def drift_counts(spark, d):
    return fnd.drift_counts(_drift(spark, d))


CLUSTERS = f"""{FINDINGS}, act AS (SELECT * FROM findings WHERE status IN ('accepted', 'deferred')),
mem AS (SELECT 'file' AS dimension, ev_path AS key, id, tag FROM act UNION SELECT 'symbol', symbol, id, tag FROM act WHERE symbol IS NOT NULL
  UNION SELECT 'entity', entity_stage, id, tag FROM act
  UNION SELECT 'dependsOn', least(x.id, x.needs) || ' <-> ' || greatest(x.id, x.needs), a.id, a.tag FROM act x JOIN act y ON y.id = x.needs JOIN act a ON a.id IN (x.id, x.needs)),
clu AS (SELECT dimension, key, count(*) AS members, count(tag) = count(*) AND coalesce(min(tag) = max(tag), false) AS anticipated FROM mem GROUP BY dimension, key HAVING count(*) >= 2)"""


@query("clusters", f"WITH {CLUSTERS} SELECT * FROM clu")
def clusters(spark, d):
    return fnd.clusters(findings(spark, d))


@query(
    "tally",
    f"""WITH {FINDINGS}, k AS (SELECT layer, tag, CAST(string_split(layer, '.')[1] AS INTEGER) * 10 + coalesce(CAST(string_split(layer, '.')[2] AS INTEGER), -1) AS o FROM findings WHERE tag IS NOT NULL),
    f AS (SELECT tag, min(o) AS first FROM k GROUP BY tag)
    SELECT layer, 'status' AS measure, status AS label, count(*) AS n FROM findings WHERE status <> 'open' GROUP BY ALL
    UNION ALL SELECT layer, 'lens', lens, count(*) FROM findings GROUP BY ALL
    UNION ALL SELECT layer, CASE WHEN o = first THEN 'tag introduced' ELSE 'tag reused' END, tag, count(*) FROM k JOIN f USING (tag) GROUP BY ALL
    UNION ALL SELECT layer, 'edges', 'dependsOn', count(needs) FROM findings GROUP BY layer HAVING count(needs) > 0""",
)
def tally(spark, d):
    return fnd.tally(findings(spark, d))


@query(
    "review_counts",
    f"""WITH {FINDINGS}, x AS (SELECT *, CASE WHEN verify = 'Falsified' THEN 'withdrawn' ELSE status END AS st FROM findings WHERE kind = 'dr')
    SELECT count(CASE WHEN st <> 'withdrawn' AND severity = 'critical' THEN 1 END) AS critical, count(CASE WHEN st <> 'withdrawn' AND severity = 'important' THEN 1 END) AS important,
      count(CASE WHEN st <> 'withdrawn' AND severity = 'suggestion' THEN 1 END) AS suggestion, count(CASE WHEN st <> 'withdrawn' AND severity = 'discuss' THEN 1 END) AS discuss,
      count(CASE WHEN verify = 'Verified' THEN 1 END) AS verified, count(CASE WHEN verify = 'Weakened' THEN 1 END) AS weakened, count(CASE WHEN verify = 'Falsified' THEN 1 END) AS falsified,
      count(CASE WHEN st <> 'withdrawn' AND severity IN ('critical', 'important') THEN 1 END) AS blockers FROM x""",
)
def review_counts(spark, d):
    f = findings(spark, d).withColumn("status", F.when(F.col("verify") == "Falsified", "withdrawn").otherwise(F.col("status")))
    return fnd.review_counts(f)


@query(
    "interaction_promotion",
    f"""WITH {FINDINGS}, r AS (SELECT *, CASE severity WHEN 'High' THEN 3 WHEN 'Med' THEN 2 WHEN 'Low' THEN 1 WHEN 'critical' THEN 3 WHEN 'important' THEN 2 WHEN 'suggestion' THEN 1 ELSE 0 END AS rk FROM findings WHERE status = 'accepted')
    SELECT kind, entity_stage AS entity, count(*) AS members, CASE kind WHEN 'dr' THEN 'critical' ELSE 'High' END AS severity, arg_max(severity, rk) AS strongest_member FROM r GROUP BY kind, entity_stage HAVING count(*) >= 2""",
)
def interaction_promotion(spark, d):
    return fnd.interaction_promotion(findings(spark, d).where("status = 'accepted'"))


@query(
    "cascade",
    """WITH t AS (SELECT user_id, bool_or(event_type = 'error') AS e, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase' AND value > 20) AS p, bool_or(event_type = 'view' AND value < 0.1) AS v FROM events GROUP BY user_id)
    SELECT user_id AS entity, 'stranded' AS rule FROM t WHERE e AND s AND p UNION ALL SELECT user_id, 'replayed' FROM t WHERE e AND v AND s""",
)
def cascade(spark, d):
    tag = (
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), "paid")
        .when((F.col("event_type") == "view") & (F.col("value") < 0.1), "glance")
        .otherwise(F.col("event_type"))
    )
    tagged = table(spark, d, "events").select(F.col("user_id").alias("entity"), tag.alias("tag"))
    return fnd.cascade(tagged, rules={"stranded": ["error", "signup", "paid"], "replayed": ["error", "glance", "signup"]})


SCORE = """sc AS (SELECT id, entity_stage, tag, CASE severity WHEN 'High' THEN 3.0 WHEN 'Med' THEN 2.0 WHEN 'Low' THEN 1.0 WHEN 'critical' THEN 4.0 WHEN 'important' THEN 3.0 WHEN 'suggestion' THEN 1.5 ELSE 0.5 END
    * CASE n % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 WHEN 2 THEN 3.0 ELSE 1.0 END / CASE effort WHEN 'S' THEN 1.0 WHEN 'M' THEN 2.0 ELSE 4.0 END AS score FROM findings WHERE status IN ('open', 'accepted', 'deferred'))"""


@query(
    "risk_rank",
    f"""WITH {FINDINGS}, {SCORE}, m AS (SELECT id, 'theme ' || entity_stage AS cluster FROM findings WHERE tag = 'tag1'),
    p AS (SELECT coalesce(cluster, sc.id) AS label, score FROM sc LEFT JOIN m USING (id))
    SELECT label, count(*) AS members, round(CAST(sum(score) AS DOUBLE), 6) AS score FROM p GROUP BY label ORDER BY sum(score) DESC, label LIMIT 3""",
)
def risk_rank(spark, d):
    f = findings(spark, d)
    members = f.where("crossCutTag = 'tag1'").select("id", F.concat(F.lit("theme "), "entityStage").alias("cluster"))
    return fnd.risk_rank(f, members).withColumn("score", F.round("score", 6))


@query(
    "risk_scores",
    f"WITH {FINDINGS}, {SCORE} SELECT id AS label, round(CAST(score AS DOUBLE), 6) AS score FROM sc",
)
def risk_scores(spark, d):
    return fnd.risk_rank(findings(spark, d), top=None).select("label", F.round("score", 6).alias("score"))


@query(
    "sarif_results",
    f"""WITH {FINDINGS}, o AS (SELECT kind, lens, row_number() OVER (PARTITION BY kind ORDER BY min(id), lens) - 1 AS rule_index FROM findings GROUP BY kind, lens)
    SELECT kind, id, CASE severity WHEN 'High' THEN 'error' WHEN 'critical' THEN 'error' WHEN 'Med' THEN 'warning' WHEN 'important' THEN 'warning' ELSE 'note' END AS level,
      CAST(CASE severity WHEN 'High' THEN 90 WHEN 'critical' THEN 90 WHEN 'Med' THEN 60 WHEN 'important' THEN 60 WHEN 'discuss' THEN 10 ELSE 30 END AS INTEGER) AS rank,
      CAST(rule_index AS INTEGER) AS rule_index, fp, ev_path AS uri, CAST(coalesce(ev_end, ev_start) AS INTEGER) AS end_line, 'new' AS baseline,
      CASE WHEN status = 'rejected' OR verify = 'Falsified' THEN coalesce(verify, status) END AS justification FROM findings JOIN o USING (kind, lens)""",
)
def sarif_results(spark, d):
    r = sarif.sarif_results(findings(spark, d))
    loc = F.element_at("result.locations", 1)["physicalLocation"]
    return r.select(
        "kind",
        "id",
        F.col("result.level").alias("level"),
        F.col("result.rank").alias("rank"),
        F.col("result.ruleIndex").alias("rule_index"),
        F.col("result.partialFingerprints")["findingFingerprint/v1"].alias("fp"),
        loc["artifactLocation"]["uri"].alias("uri"),
        loc["region"]["endLine"].alias("end_line"),
        F.col("result.baselineState").alias("baseline"),
        F.get("result.suppressions", F.lit(0))["justification"].alias("justification"),
    )


@query(
    "write_sarif",
    f"""WITH {FINDINGS} SELECT kind, lens AS rule, count(*) AS results, count(CASE WHEN status = 'rejected' OR verify = 'Falsified' THEN 1 END) AS suppressed FROM findings GROUP BY kind, lens""",
)
def write_sarif(spark, d):
    path = scratch_path(spark, "sarif")
    sarif.write_sarif(findings(spark, d), path, per_log=100)
    # The reader gets a schema, so no inference pass runs over the export.
    logs = spark.read.schema("version string, runs array<struct<results: array<struct<ruleId: string, suppressions: array<struct<kind: string>>>>>>, kind string").json(path, multiLine=True)
    back = logs.where("version = '2.1.0'").select("kind", F.explode(F.flatten("runs.results")).alias("r")).select("kind", "r.*")
    return back.groupBy("kind", F.col("ruleId").alias("rule")).agg(
        F.count(F.lit(1)).alias("results"), F.count("suppressions").alias("suppressed")
    )
