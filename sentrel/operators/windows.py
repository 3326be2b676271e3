"""Counts in moving windows of time, in linear work and without a task for a whole key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE = 86_400


def moving_counts(events: DataFrame, key: list[str], who: str, back: int, ahead: int) -> DataFrame:
    """key, ts, different, n: at each whole second ts at which a key has events, how many different `who` and how many events
    it has from ts - back to ts + ahead. A null who counts as an event only; events without a time are left out.

    Each event adds one from the moment at which it is its who's first in the window until it leaves, so the counts are
    running sums of steps: no sets are held, and a busy window costs no more than a quiet one. Sums run within slices of
    SLICE seconds, and on from the totals of the slices before, so a key with a third of all rows is spread over its days;
    equal keys, seconds and who are combined before the first shuffle."""
    e = events.where("ts is not null").groupBy(*key, F.col("ts").cast("long").alias("ts"), F.col(who).alias("__who")).agg(F.count("*").alias("__n"))
    last = F.lag("ts").over(W.partitionBy(*key, "__who").orderBy("ts"))
    e = e.withColumn("__from", F.greatest(F.col("ts") - ahead, F.coalesce(last + back + 1, F.col("ts") - ahead)))
    one, none, true, false = F.when(F.col("__who").isNotNull(), 1).otherwise(0), F.lit(0), F.lit(True), F.lit(False)
    step = lambda at, d, n, point: F.struct(at.alias("at"), d.cast("long").alias("d"), n.cast("long").alias("n"), point.alias("point"))
    steps = F.array(
        step(F.col("__from"), one, none, false), step(F.col("ts") - ahead, none, F.col("__n"), false),
        step(F.col("ts") + back + 1, -one, -F.col("__n"), false), step(F.col("ts"), none, none, true),
    )
    moves = e.select(*key, F.explode(steps).alias("s")).groupBy(*key, "s.at").agg(F.sum("s.d").alias("d"), F.sum("s.n").alias("n"), F.max("s.point").alias("point"))
    moves = moves.withColumn("slice", F.floor(F.col("at") / SLICE))
    before = W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    totals = moves.groupBy(*key, "slice").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("slice").alias("__slice"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("d", "n")])
    along = W.partitionBy(*key, "slice").orderBy("at")
    inner = moves.withColumns({"d": F.sum("d").over(along), "n": F.sum("n").over(along)}).where("point")
    same = reduce(lambda a, b: a & b, [inner[k].eqNullSafe(totals[f"__{k}"]) for k in key], inner["slice"] == totals["__slice"])
    return inner.join(totals, same).select(*key, F.col("at").alias("ts"), (F.col("d") + F.col("__d")).alias("different"), (F.col("n") + F.col("__n")).alias("n"))
