"""Events of a stream as a spool of segments on disk, each batch once, with counters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sentrel.sources.sinks import EVENT_KEYS, shaped


def _ledger(spark: SparkSession, out: str) -> list[dict]:
    """What earlier batches wrote: one small row for each batch of the segments that are kept, and the totals before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    newest = max((s.getPath().getName() for s in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), default=None)
    return [json.loads(r.value) for r in spark.read.text(f"{out}/ledger/{newest}").collect()] if newest else []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_batch(batch: DataFrame, number: int, out: str, rows: int = 100_000, kept: int = 2) -> dict[str, int]:
    """Writes one batch's events of the right shape; returns the totals of all batches: written, dropped, segment.

    A segment takes batches until it holds `rows` events; then the next begins, and all but the `kept` newest go. A batch
    that is done again goes to the folder that it had, and counts once. The ledger, a new small file for each batch, is
    written last, so a failure before leaves the batch to be done again."""
    spark = batch.sparkSession
    known = _ledger(spark, out)
    before = next((k for k in known if k["batch"] == number), None)
    last = max((k["segment"] for k in known), default=0)
    full = sum(k["written"] for k in known if k["segment"] == last and k["batch"] >= 0) >= rows
    segment = before["segment"] if before else last + full
    seen = Observation()
    marked = batch.withColumn("__good", shaped(batch)).observe(seen, F.count_if("__good").alias("written"), F.count_if(~F.col("__good")).alias("dropped"))
    marked.where("__good").select(*[c for c in EVENT_KEYS if c in batch.columns]).write.mode("overwrite").json(f"{out}/segment={segment}/batch={number}")
    counts = seen.get
    now = [k for k in known if k["batch"] != number] + [{"batch": number, "segment": segment, "written": counts["written"], "dropped": counts["dropped"]}]
    newest = max(k["segment"] for k in now)
    old = [k for k in now if k["segment"] <= newest - kept]
    # batches of segments that went are summed in one row, batch -1
    gone = {"batch": -1, "segment": -1, "written": sum(k["written"] for k in old), "dropped": sum(k["dropped"] for k in old)}
    now = [k for k in now if k["segment"] > newest - kept] + ([gone] if old else [])
    spark.createDataFrame([(json.dumps(k),) for k in now], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/ledger/{number:012d}")
    for s in {k["segment"] for k in old if k["segment"] >= 0}:
        _delete(spark, f"{out}/segment={s}")
    return {"written": sum(k["written"] for k in now), "dropped": sum(k["dropped"] for k in now), "segment": newest}


def spool_stream(stream: DataFrame, out: str, checkpoint: str, rows: int = 100_000, kept: int = 2) -> None:
    """Spools all that is there and stops; a further call goes on behind it."""
    stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, out, rows, kept) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
