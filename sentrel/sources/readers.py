"""Readers of transaction dumps, transcripts, settings and tool lists. Unreadable input is told apart from empty input by a
status column; shapes differ between rows, so bodies are variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

SKIPPED = ["node_modules", "dist", "build", "target", "venv", "__pycache__"]


def files(spark: SparkSession, root: str, glob: str = "*", depth: int | None = None) -> DataFrame:
    """path, modified, size, text, valid of files below root; skipped folders and, with depth, deeper ones are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    out = raw.where(~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED])))
    if depth is not None:
        levels = len([p for p in root.split(":")[-1].split("/") if p])
        out = out.where(F.size(F.filter(parts, lambda p: (p != "") & ~F.endswith(p, F.lit(":")))) - levels <= depth)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return out.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), text.alias("text"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def first_of(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first present value of several places in a variant."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """path, status, tx (variant): a JSON list, one object, lines of JSON, or a list under result, transactions, data or
    items. status: ok, empty (white space only; files of no bytes give no row) or unreadable, the latter two without tx."""
    whole = spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    v = F.try_parse_json("text")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    parsed = whole.withColumns({"v": v, "lines": lines})
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("result", "transactions", "data", "items")], F.try_variant_get("v", "$", "array<variant>"))
    rows = F.when(F.col("v").isNull(), F.filter(F.transform("lines", lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())).otherwise(F.coalesce(inner, F.array("v")))
    status = F.when(F.size("lines") == 0, "empty").when(F.size("rows") == 0, "unreadable").otherwise("ok")
    return parsed.withColumn("rows", rows).withColumn("status", status).select("path", "status", F.explode_outer("rows").alias("tx"))


def memos(txs: DataFrame) -> DataFrame:
    """signature, sender, memo: texts of a transaction's own memo fields and parsed instructions, each text once; log lines
    only where there is none of these."""
    tx = F.col("tx")
    signature = first_of(tx, "$.signature", "$.transaction.signatures[0]", "$._prov.signature")
    sender = first_of(tx, "$.feePayer", "$.transaction.message.accountKeys[0].pubkey", "$.transaction.message.accountKeys[0]")
    outer = F.coalesce(F.try_variant_get(tx, "$.transaction.message.instructions", "array<variant>"), F.array())
    inner = F.flatten(F.transform(F.coalesce(F.try_variant_get(tx, "$.meta.innerInstructions", "array<variant>"), F.array()), lambda i: F.coalesce(F.try_variant_get(i, "$.instructions", "array<variant>"), F.array())))
    said = F.transform(F.concat(outer, inner), lambda i: F.when(F.contains(F.lower(first_of(i, "$.program", "$.programId")), F.lit("memo")), first_of(i, "$.parsed.info.memo", "$.parsed.memo", "$.parsed")))
    direct = F.filter(F.concat(F.array(F.try_variant_get(tx, "$.memo", "string"), F.try_variant_get(tx, "$.description", "string")), said), lambda m: m.isNotNull())
    logs = F.filter(F.transform(F.coalesce(F.try_variant_get(tx, "$.meta.logMessages", "array<string>"), F.array().cast("array<string>")), lambda x: F.when(F.contains(x, F.lit("Memo (len")), F.regexp_extract(x, 'Memo \\(len [0-9]+\\): "(.*)"', 1))), lambda m: m.isNotNull())
    texts = F.array_distinct(F.when(F.size(direct) > 0, direct).otherwise(logs))
    return txs.where("tx is not null").select(signature.alias("signature"), sender.alias("sender"), F.explode(texts).alias("memo")).withColumn("memo", F.regexp_replace("memo", r"^\[\d+\]\s?", ""))


def transcripts(spark: SparkSession, path: str, lines: int | None = None) -> DataFrame:
    """path, line, type, ts, channel, tool, text: tool results and spawned tasks of session logs; malformed lines are left
    out. With lines, only that many at the head of each file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    if lines is not None:
        whole = whole.where(F.col("line") < lines)
    v = whole.withColumn("v", F.try_parse_json("raw")).where("v is not null")
    blocks = F.coalesce(F.try_variant_get("v", "$.message.content", "array<variant>"), F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), F.try_variant_get("v", "$.message.content", "string").alias("text"))))))
    b = v.select("path", "line", F.try_variant_get("v", "$.type", "string").alias("type"), F.try_variant_get("v", "$.timestamp", "string").alias("ts"), F.explode(blocks).alias("b"))
    nested = F.array_join(F.transform(F.try_variant_get("b", "$.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), "\n")
    task = F.concat_ws("\n", *[F.try_variant_get("b", f"$.input.{k}", "string") for k in ("prompt", "description", "task")])
    kind = F.try_variant_get("b", "$.type", "string")
    text = F.when(kind == "tool_use", task).otherwise(F.coalesce(nested, F.try_variant_get("b", "$.content", "string"), F.try_variant_get("b", "$.text", "string")))
    return b.select("path", "line", "type", "ts", kind.alias("channel"), F.try_variant_get("b", "$.name", "string").alias("tool"), text.alias("text")).where("text is not null")


def tools(configs: DataFrame) -> DataFrame:
    """server, tool, description, sha256 of tool definitions in configs (path, text)."""
    servers = F.try_variant_get(F.try_parse_json("text"), "$.mcpServers", "map<string,variant>")
    each = configs.select("path", F.explode(servers).alias("server", "s"))
    listed = each.select("path", "server", F.explode(F.try_variant_get("s", "$.tools", "array<variant>")).alias("t"))
    name, about = F.try_variant_get("t", "$.name", "string"), F.coalesce(F.try_variant_get("t", "$.description", "string"), F.lit(""))
    return listed.select("server", name.alias("tool"), F.substring(about, 1, 400).alias("description"), F.sha2(F.concat_ws("\n", name, about, F.to_json("t")), 256).alias("sha256"))


CANARY = "address string, label string, chain string, placement string, planted_ts double"


def canaries(spark: SparkSession, path: str) -> DataFrame:
    """The private registry: JSON files in a folder or at a path, each a list of canaries or an object with the list in
    canaries; a missing path is an empty registry. Entries without an address, and files that are no JSON, are refused."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CANARY)
    v = files.select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.canaries", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    each = v.select(F.explode(F.coalesce(listed, F.raise_error(F.lit("a registry holds a list of canaries")))).alias("c"))
    text = lambda k, other: F.coalesce(F.try_variant_get("c", f"$.{k}", "string"), F.lit(other)).alias(k)
    address = F.coalesce(F.try_variant_get("c", "$.address", "string"), F.raise_error(F.lit("a canary has an address")).cast("string"))
    return each.select(address.alias("address"), text("label", ""), text("chain", "solana"), text("placement", ""), F.try_variant_get("c", "$.planted_ts", "double").alias("planted_ts"))
