"""Sinks: findings as JSON rows, as a SARIF document, and as an append-only spool behind a shape gate."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_KEYS = ["code", "severity", "decision", "chain_id", "payee_hash", "amount_bucket", "ts"]


def as_json(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(F.to_json(F.struct(*[F.col(c) for c in (*keys, "rule_id", "severity", "line")]), {"ignoreNullFields": "false"}).alias("value"))


SEVERITIES = ["critical", "high", "medium", "low", "info"]


def rank(severity: Column) -> Column:
    """0 for critical to 4 for info; 5 for anything else."""
    at = F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), severity)
    return F.when(at > 0, at - 1).otherwise(F.lit(5))


def ranked(found: DataFrame) -> DataFrame:
    """Findings from the worst to the least, equal ones by rule."""
    return found.orderBy(rank(F.col("severity")), "rule_id")


def sarif_results(found: DataFrame, uri: str) -> DataFrame:
    """One SARIF result a row, as JSON in column value, worst first; all findings, suppressed ones marked, no excerpts."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    where = F.struct(F.struct(F.struct(F.col(uri).cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    marks = F.when(F.col("suppressed"), F.array(F.struct(F.lit("inSource").alias("kind")))) if "suppressed" in found.columns else F.lit(None).cast("array<struct<kind:string>>")
    row = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("rule_id").alias("text")).alias("message"), F.array(where).alias("locations"), marks.alias("suppressions"))
    return found.orderBy(rank(F.col("severity")), "rule_id", uri, "line").select(F.to_json(row).alias("value"))


def sarif(found: DataFrame, uri: str, path: str, tool: str = "sentrel") -> None:
    """A SARIF 2.1.0 document as text files below path: head, results and tail in the order of their names. Results are
    written by the executors, so their number is not bounded; only the rule ids, a fixed vocabulary, come to the driver."""
    spark = found.sparkSession
    worst = found.groupBy("rule_id").agg(F.min_by("severity", rank(F.col("severity"))).alias("severity")).orderBy("rule_id").collect()
    rules = [{"id": r.rule_id, "name": r.rule_id, "shortDescription": {"text": r.rule_id}, "properties": {"severity": r.severity}} for r in worst]
    head = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}
    begin = json.dumps(head)[:-1] + ', "runs": [{"tool": ' + json.dumps({"driver": {"name": tool, "rules": rules}}) + ', "results": ['
    results = sarif_results(found, uri)
    spark.createDataFrame([(begin,)], "value string").coalesce(1).write.text(f"{path}/1-head")
    numbered = results.withColumn("i", F.monotonically_increasing_id())
    numbered.select(F.concat(F.when(F.col("i") == 0, "").otherwise(","), "value").alias("value")).write.text(f"{path}/2-results")
    spark.createDataFrame([("]}]}",)], "value string").coalesce(1).write.text(f"{path}/3-tail")


def fails(found: DataFrame, at_least: str) -> bool:
    """Whether any finding is at least so severe."""
    return not found.where(rank(F.col("severity")) <= SEVERITIES.index(at_least)).isEmpty()


def shaped(events: DataFrame) -> Column:
    """Whether an event has the shape that may be stored."""
    good = F.col("code").rlike("^[A-Z0-9-]{3,16}$") & F.col("severity").isin(*SEVERITIES) & F.col("decision").isin("allow", "refuse", "abstain")
    return F.coalesce(good, F.lit(False))


def spool(events: DataFrame, path: str, rows_per_file: int = 100_000) -> dict[str, int]:
    """Appends events of the right shape as JSON lines; returns how many were written and how many left out."""
    from pyspark.sql import Observation

    seen = Observation()
    marked = events.withColumn("__good", shaped(events)).observe(seen, F.count_if("__good").alias("written"), F.count_if(~F.col("__good")).alias("dropped"))
    marked.where("__good").select(*[c for c in EVENT_KEYS if c in events.columns]).write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)
    return seen.get
