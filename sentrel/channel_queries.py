"""Named queries over decisions of channels and canaries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.operators import channels, flows
from sentrel.oracle import EVENTS, FOUND, q
from sentrel.plans.carriers import seeded
from sentrel.queries import events, table

_TOOLS = ["Read", "Task", "mcp__slack__post_message", "Write", "Bash", "Edit", "SendMessage"]
_PATHS = ["a/AGENTS.md", "skills/x/notes.md", "src/notes.md", ".cursor/rules/y.mdc", "src/.md"]


def _pick(values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values)).cast("int"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, tool, path, body: each document with its payload as a call, tool and path by its id."""
    return seeded(spark, d).select("doc_id", _pick(_TOOLS).alias("tool"), _pick(_PATHS).alias("path"), "body")


def _broken(text: Column) -> Column:
    return F.when(F.col("doc_id") % 13 == 0, F.substring(text, 1, 20)).otherwise(text)


def write_decisions(spark, d):
    given = F.when(F.col("tool") == "Write", F.to_json(F.struct(F.col("body").alias("content")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("old_string"), F.col("body").alias("new_string"))).alias("edits"))))
    out = channels.pending_writes(calls(spark, d).withColumn("given", _broken(given)), True)
    return out.select("doc_id", "decision", F.array_join("rules", ",").alias("rules")).where("decision <> 'allow'")


def output_decisions(spark, d):
    out = channels.tool_outputs(calls(spark, d), "body").where("decision <> 'pass'")
    return out.select("doc_id", F.array_join("rules", ",").alias("rules"), F.sha2("redacted", 256).alias("digest"))


def message_decisions(spark, d):
    given = F.to_json(F.struct(F.lit(7).alias("channel"), F.array(F.col("body")).alias("message"), F.lit(1).alias("text")))
    out = channels.messages(calls(spark, d).withColumn("given", _broken(given)))
    return out.select("doc_id", "decision", "worst", F.array_join("rules", ",").alias("rules")).where("decision <> 'allow'")


def canary_report(spark, d):
    """Every ninth customer as a canary."""
    planted = table(spark, d, "customer").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("address"))
    return flows.canary_report(events(spark, d), planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (write_decisions, output_decisions, message_decisions, canary_report)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


_TOOL, _PATH = f"{_list(_TOOLS)}[doc_id % {len(_TOOLS)} + 1]", f"{_list(_PATHS)}[doc_id % {len(_PATHS)} + 1]"
_MARKS = " + ".join(f"(length(body) - length(replace(body, {q(m)}, '')))::DOUBLE / {len(m)}" for m in channels.CODE_MARKS)
_ROWS = "list_filter(string_split(body, chr(10)), lambda z: trim(z) <> '')"
_NUMBERED = f"len(list_filter({_ROWS}, lambda z: regexp_matches(z, '^[ ]*[0-9]+\\t')))"
_CODE = f"(len({_ROWS}) >= 3 AND {_MARKS} > len({_ROWS}) * CASE WHEN {_NUMBERED} >= greatest(3, len({_ROWS}) // 2) THEN 0.4 ELSE 1.5 END)"
_IDS = "string_agg(rule_id, ',' ORDER BY rule_id)"

SQL: dict[str, str] = {
    "write_decisions": FOUND + f""", w AS (SELECT doc_id, body FROM p WHERE {_TOOL} IN ('Write', 'Edit') AND {_PATH} IN ('a/AGENTS.md', 'skills/x/notes.md', '.cursor/rules/y.mdc'))
 SELECT doc_id, 'ask' AS decision, '' AS rules FROM w WHERE doc_id % 13 = 0
 UNION ALL SELECT doc_id, CASE WHEN bool_or(rule_id IN ('INJ-001', 'INJ-003')) THEN 'block' ELSE 'warn' END, {_IDS} FROM f WHERE doc_id % 13 <> 0 AND doc_id IN (SELECT doc_id FROM w) GROUP BY doc_id""",
    "output_decisions": FOUND + f""", w AS (SELECT doc_id, rule_id, line FROM f WHERE rule_id IN ({', '.join(q(r) for r in channels.ACTIONABLE)}) AND {_TOOL} IN ('Read', 'Task', 'mcp__slack__post_message', 'Bash') AND NOT {_CODE}),
 l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM p WHERE doc_id IN (SELECT doc_id FROM w)),
 g AS (SELECT doc_id, line AS i, string_agg(rule_id, ', ' ORDER BY rule_id) AS ids FROM w GROUP BY ALL),
 r AS (SELECT doc_id, string_agg(CASE WHEN ids IS NULL THEN x ELSE '[line removed: ' || ids || ']' END, chr(10) ORDER BY i) AS text FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
 SELECT doc_id, rules, sha256(text) AS digest FROM r JOIN (SELECT doc_id, {_IDS} AS rules FROM w GROUP BY doc_id) USING (doc_id)""",
    "message_decisions": FOUND + f""", w AS (SELECT doc_id, rule_id, severity FROM f WHERE doc_id % 13 <> 0 AND rule_id <> 'INJ-008' AND {_TOOL} IN ('Task', 'mcp__slack__post_message', 'SendMessage') AND NOT {_CODE})
 SELECT doc_id, 'ask' AS decision, NULL AS worst, '' AS rules FROM p WHERE doc_id % 13 = 0 AND {_TOOL} IN ('Task', 'mcp__slack__post_message', 'SendMessage')
 UNION ALL SELECT doc_id, 'deny', arg_min(rule_id, (severity <> 'critical', rule_id)), {_IDS} FROM w GROUP BY doc_id""",
    "canary_report": f"""WITH {EVENTS}, c AS (SELECT c_custkey AS a FROM customer WHERE c_custkey % 9 = 0), h AS (SELECT tx, CASE WHEN recipient IN (SELECT a FROM c) THEN recipient ELSE sender END AS a, recipient IN (SELECT a FROM c) AS inward FROM e WHERE recipient IN (SELECT a FROM c) OR sender IN (SELECT a FROM c))
 SELECT substr(sha256(c.a::VARCHAR), 1, 12) AS fingerprint, count(tx) FILTER (WHERE inward) AS inbound, count(tx) FILTER (WHERE NOT inward) AS outbound FROM c LEFT JOIN h ON c.a = h.a GROUP BY c.a""",
}
