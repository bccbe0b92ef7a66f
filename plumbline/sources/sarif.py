"""Findings export as SARIF 2.1.0.

Results are produced by a plain projection and written in parallel as logs of
bounded size. The rule list has one row per fired lens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import to_posix

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"

# Results of one log on average; a viewer opens a log as a whole.
PER_LOG = 5000

# Severity to result level and rank.
LEVELS = {
    "High": "error", "Med": "warning", "Low": "note",
    "critical": "error", "important": "warning", "suggestion": "note", "discuss": "note",
}
RANKS = {"High": 90, "critical": 90, "Med": 60, "important": 60, "Low": 30, "suggestion": 30, "discuss": 10}


def lookup(table: dict[str, object], key: Column, default: object = None) -> Column:
    out: Column | None = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def sarif_rules(findings: DataFrame) -> DataFrame:
    """``kind, lens, rule_index``: fired lenses per kind in order of first id."""
    from pyspark.sql import Window

    seen = findings.groupBy(F.coalesce("kind", F.lit("ar")).alias("kind"), "lens").agg(F.min("id").alias("first_id"))
    order = Window.partitionBy("kind").orderBy("first_id", "lens")
    return seen.select("kind", "lens", (F.row_number().over(order) - 1).alias("rule_index"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """``kind, id, result`` with the nested SARIF result struct."""
    # Rules and kinds are few, and one of them may have most findings: no finding is shuffled for them.
    rules = F.broadcast(sarif_rules(findings))
    f = findings.withColumn("kind", F.coalesce("kind", F.lit("ar"))).join(rules, ["kind", "lens"])
    locations = F.transform(
        "evidence",
        lambda e: F.struct(
            F.struct(
                F.struct(to_posix(e["path"]).alias("uri")).alias("artifactLocation"),
                F.struct(
                    e["startLine"].alias("startLine"),
                    F.coalesce(e["endLine"], e["startLine"]).alias("endLine"),
                    F.struct(F.array_join(e["quoted"], "\n").alias("text")).alias("snippet"),
                ).alias("region"),
            ).alias("physicalLocation")
        ),
    )
    retired = (
        F.coalesce(F.col("status").isin("rejected", "withdrawn"), F.lit(False))
        | F.coalesce(F.col("verify") == "Falsified", F.lit(False))
    )
    suppressions = F.when(
        retired,
        F.array(
            F.struct(
                F.lit("external").alias("kind"),
                F.coalesce("statusNote", "verifyNote", "verify", "status").alias("justification"),
            )
        ),
    )
    properties = F.struct(
        "lens",
        "severity",
        F.col("class"),
        "entityStage",
        "crossCutTag",
        "driftClass",
        F.col("priorFp").alias("priorFingerprint"),
        "priorId",
    )
    result = F.struct(
        F.col("lens").alias("ruleId"),
        F.col("rule_index").alias("ruleIndex"),
        lookup(LEVELS, F.col("severity"), "warning").alias("level"),
        F.struct(F.col("title").alias("text")).alias("message"),
        locations.alias("locations"),
        F.struct(F.col("fp").alias("findingFingerprint/v1")).alias("partialFingerprints"),
        F.coalesce("baselineState", F.lit("new")).alias("baselineState"),
        lookup(RANKS, F.col("severity")).alias("rank"),
        suppressions.alias("suppressions"),
        properties.alias("properties"),
    )
    return f.select("kind", "id", result.alias("result"))


def sarif_logs(findings: DataFrame, tool: str = "plumbline", per_log: int = PER_LOG) -> DataFrame:
    """``kind, log``: complete SARIF logs of about ``per_log`` results each.

    Results are dealt to logs by a hash of their id, so no row holds a kind's
    whole run; each log repeats the kind's rules.
    """
    results = sarif_results(findings)
    sizes = results.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / per_log).alias("_logs"))
    dealt = results.join(F.broadcast(sizes), "kind").withColumn("_log", F.pmod(F.xxhash64("id"), F.col("_logs")))
    groups = dealt.groupBy("kind", "_log").agg(F.sort_array(F.collect_list(F.struct("id", F.to_json("result").alias("r")))).alias("rs"))
    rules = sarif_rules(findings).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("rule_index", "lens"))).alias("ls"))
    described = F.transform(
        "ls",
        lambda x: F.struct(
            x["lens"].alias("id"), x["lens"].alias("name"), F.struct(F.concat(F.lit("lens "), x["lens"]).alias("text")).alias("shortDescription")
        ),
    )
    driver = F.to_json(F.struct(F.concat_ws("-", F.lit(tool), "kind").alias("name"), described.alias("rules")))
    body = F.array_join(F.transform("rs", lambda x: x["r"]), ",")
    text = F.concat(
        F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":'), driver, F.lit('},"results":['), body, F.lit("]}]}")
    )
    return groups.join(F.broadcast(rules), "kind").select("kind", text.alias("log"))


def write_sarif(findings: DataFrame, path: str, tool: str = "plumbline", per_log: int = PER_LOG) -> None:
    """One file per log, below a folder per kind; every file is a whole SARIF 2.1.0 document."""
    logs = sarif_logs(findings, tool, per_log).select("kind", F.col("log").alias("value"))
    logs.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("kind").text(path)
