"""Verdict streams: correlation bursts, invoices, replays, receipts and spending caps. Times are seconds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrel.operators.windows import moving_counts


def bursts(events: DataFrame, key: list[str], seconds: int, least: int) -> DataFrame:
    """key, ts, callers, n: per key the fullest forward window with `least` different callers; ties go to the earliest."""
    seen = moving_counts(events, key, "caller", 0, seconds).withColumnRenamed("different", "callers")
    best = seen.where(F.col("callers") >= least).groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("o"), "ts", "callers", "n")).alias("b"))
    return best.select(*key, "b.ts", "b.callers", "b.n")


def invoice(events: DataFrame, flat: int = 25_000_000, included: int = 10_000, rate: int = 3000, billable: tuple = ("click", "view", "purchase")) -> DataFrame:
    """caller, checks, billable, amount in millionths: a flat fee and a rate for what exceeds the included number."""
    out = events.groupBy("caller").agg(F.count("*").alias("checks"), F.count_if(F.col("kind").isin(*billable)).alias("billable"))
    return out.withColumn("amount", flat + F.greatest(F.lit(0), F.col("billable") - included) * rate)


def replays(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Events whose key was seen before."""
    return events.withColumn("seen", F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1).where("seen > 0")


def receipt(fields: list[tuple[str, Column]]) -> Column:
    """Hash of name=value lines in the given order; null is told apart from every text."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{n}="), F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))) for n, c in fields]), 256)


def spend_ledger(orders: DataFrame, key: str, allowed: list, cap: float, daily: float, seconds: int = 86_400) -> DataFrame:
    """key, id, decision of orders (key, id, ts, symbol, amount) in order of (ts, id). An accepted order counts towards the
    trailing total, a refused one does not, so the fold is sequential per key and state is the accepted orders of one day.
    Rows of a key arrive in order and are streamed; only the trailing day is held."""
    types = {f.name: f.dataType.simpleString() for f in orders.schema}
    out_schema = f"{key} {types[key]}, id {types['id']}, decision string"
    names = set(allowed)

    def fold(batches: Iterator) -> Iterator:
        import collections

        import pyarrow as pa

        now, held, total = object(), collections.deque(), 0.0
        for batch in batches:
            keys, times, symbols, amounts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            out = []
            for k, t, s, a in zip(keys, times, symbols, amounts):
                if k != now:
                    now, held, total = k, collections.deque(), 0.0
                while held and held[0][0] < t - seconds:
                    total -= held.popleft()[1]
                kind = "symbol" if s not in names else "unknown" if a is None else "order_cap" if a > cap else "daily_cap" if round(total + a, 6) > daily else "accept"
                if kind == "accept":
                    held.append((t, a))
                    total = total + a if len(held) > 1 else a
                out.append(kind)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], [key, "id", "decision"])

    dealt = orders.select(key, "id", "ts", "symbol", "amount").repartition(key).sortWithinPartitions(key, "ts", "id")
    return dealt.mapInArrow(fold, out_schema)
