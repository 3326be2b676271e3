"""The same transforms over streams: replay of saved files, idempotent micro-batches, replays of nonces, spending caps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sentrel.operators.rules import scan


def replay(spark: SparkSession, folder: str, schema: T.StructType | str, files: int = 1, kind: str = "parquet") -> DataFrame:
    """A stream over saved files, some files a batch; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def scan_stream(stream: DataFrame, text: str, out: str, checkpoint: str, channel: str = "memo") -> None:
    """Scans all that is there and stops. Each batch goes to a folder of its own number, so one that is done again after
    a failure replaces itself and rates are not inflated."""

    def write(batch: DataFrame, number: int) -> None:
        marked = scan(batch, text, channel).withColumn("carrier", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        marked.dropDuplicates(["carrier"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_nonces(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key within the delay; state is dropped with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def capped_spending(orders: DataFrame, cap: float, daily: float, seconds: int = 86_400) -> DataFrame:
    """key, id, decision of a stream of (key, id, ts seconds, amount): accepted orders of the trailing day are the state."""

    def decide(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        times, amounts = state.get if state.exists else ([], [])
        held = list(zip(times, amounts))
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for i, t, a in zip(rows["id"].tolist(), rows["ts"].tolist(), rows["amount"].tolist()):
            held = [(x, y) for x, y in held if x >= t - seconds]
            kind = "order_cap" if a > cap else "daily_cap" if round(sum(y for _, y in held) + a, 6) > daily else "accept"
            held += [(t, a)] if kind == "accept" else []
            out.append(kind)
        state.update(([x for x, _ in held], [y for _, y in held]))
        yield pd.DataFrame({"key": [key[0]] * len(out), "id": rows["id"].tolist(), "decision": out})

    return orders.groupBy("key").applyInPandasWithState(decide, "key long, id long, decision string", "times array<long>, amounts array<double>", "append", GroupStateTimeout.NoTimeout)
