"""Captured files as stored state: an append-only log of captures and restores, payloads beside it, folded when read.

Below a root stand log/gen=N (rows of LOG, appended), payload (id, text) and manifest. The state of an id is a fold that
order and repeats don't change, so a step that is done again after a failure leaves the same state. Payloads are written
before the log says so; a payload without its entry is not part of the state. Compaction writes the folded log as the next
generation; readers take the newest one that is whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.operators.excision import excise_until_clean
from sentrel.operators.host import captures, restore
from sentrel.sources.work import settled

LOG = "id string, action string, at long, path string, rules array<string>, severity string, line int, original_sha256 string, cleaned_sha256 string"
FACTS = ["path", "rules", "severity", "line", "original_sha256", "cleaned_sha256"]


def _exists(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def generation(spark: SparkSession, root: str) -> int:
    """The newest whole generation of the log; 0 before anything was written."""
    found = [int(m[1]) for name in _exists(spark, f"{root}/log") if (m := re.fullmatch(r"gen=(\d+)", name))]
    return max([g for g in found if "_SUCCESS" in _exists(spark, f"{root}/log/gen={g}")], default=0)


def log(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/log/gen={generation(spark, root)}"
    return spark.read.schema(LOG).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LOG)


def folded(rows: DataFrame) -> DataFrame:
    """One row for each captured id: facts of its capture, captured_at, restored, restored_at. Rows that restore an id that
    was never captured give nothing."""
    at = lambda action: F.min(F.when(F.col("action") == action, F.col("at")))
    facts = [F.min_by(c, "at").alias(c) for c in FACTS if c in rows.columns]
    kept = rows.groupBy("id").agg(at("captured").alias("captured_at"), at("restored").alias("restored_at"))
    told = rows.where("action = 'captured'").groupBy("id").agg(*facts) if facts else None
    out = kept.where("captured_at is not null").withColumn("restored", F.col("restored_at").isNotNull())
    return out.join(told, "id") if told is not None else out


def state(spark: SparkSession, root: str) -> DataFrame:
    return folded(log(spark, root))


def payloads(spark: SparkSession, root: str) -> DataFrame:
    kind = "id string, text string"
    path = f"{root}/payload"
    return (spark.read.schema(kind).parquet(path) if _exists(spark, path) else spark.createDataFrame([], kind)).dropDuplicates(["id"])


def _append(rows: DataFrame, root: str) -> None:
    spark = rows.sparkSession
    have = {c: F.col(c) for c in rows.columns}
    shaped = rows.select(*[(have.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in spark.createDataFrame([], LOG).schema])
    shaped.write.mode("append").parquet(f"{root}/log/gen={generation(spark, root)}")


def capture(files: DataFrame, root: str, at: int) -> DataFrame:
    """files (path, text): cuts what the rules find and keeps the originals of all files that changed. Returns path, clean
    and excised of every file; files captured before, by path and content, are not captured again."""
    spark = files.sparkSession
    cleaned = settled(excise_until_clean(files.select("path", "text"), ["path"], "text"), "captured")
    entries = captures(cleaned.withColumns({"key": F.col("path"), "at": F.lit(at).cast("long")}), "key", "path", "at").dropDuplicates(["id"])
    fresh = settled(entries.join(log(spark, root).where("action = 'captured'").select("id"), "id", "left_anti"), "entries")
    fresh.select("id", F.col("original").alias("text")).write.mode("append").parquet(f"{root}/payload")
    _append(fresh.withColumns({"action": F.lit("captured"), "at": F.col("captured_at")}), root)
    return cleaned.select("path", "clean", "excised")


def restored(spark: SparkSession, root: str, wanted: DataFrame, at: int) -> DataFrame:
    """wanted (id): id, status, path, original as restore() says; what is restored now is so from now on."""
    entries = state(spark, root).join(payloads(spark, root).withColumnRenamed("text", "original"), "id", "left")
    answer = settled(restore(entries, wanted), "restored")
    _append(answer.where("status = 'restored'").select("id", F.lit("restored").alias("action"), F.lit(at).alias("at")), root)
    return answer


def compact(spark: SparkSession, root: str) -> int:
    """Writes the folded log as the next generation and a manifest of it; returns its number."""
    n = generation(spark, root) + 1
    now = settled(state(spark, root), "state")
    rows = now.select("id", F.lit("captured").alias("action"), F.col("captured_at").alias("at"), *FACTS)
    back = now.where("restored").select("id", F.lit("restored").alias("action"), F.col("restored_at").alias("at"))
    rows.unionByName(back, allowMissingColumns=True).select(*spark.createDataFrame([], LOG).columns).write.mode("overwrite").parquet(f"{root}/log/gen={n}")
    facts = now.agg(F.lit(n).alias("generation"), F.count("*").alias("entries"), F.count_if("restored").alias("restored"), F.hex(F.bit_xor(F.xxhash64("id", "original_sha256", "restored"))).alias("digest"))
    facts.write.mode("overwrite").json(f"{root}/manifest/gen={n}")
    return n


def export(spark: SparkSession, root: str, dest: str) -> int:
    """Samples (id, rules, captured_at, text) of all entries whose payload is there, as Parquet that nothing loads as
    settings, and a manifest; returns how many."""
    rows = settled(state(spark, root).join(payloads(spark, root), "id").select("id", "rules", "captured_at", "text"), "export")
    rows.write.mode("overwrite").parquet(f"{dest}/samples")
    rows.select("id", "rules", "captured_at", F.concat(F.col("id"), F.lit(".sample")).alias("file")).write.mode("overwrite").json(f"{dest}/manifest")
    return rows.count()
