"""Snapshots, drift, attribution to sessions, capability scores, and projections that may leave the house."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel import lexicon as L
from sentrel.functions.textops import once

#: Columns that an exported finding may have; nothing with text in it.
SAFE = ("rule_id", "severity", "line", "content_hash", "path_hash", "line_count")


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """key, state: changed, missing or new between two tables of (key, sha256). One full outer join."""
    b, c = baseline.select("key", F.col("sha256").alias("was")), current.select("key", F.col("sha256").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
    return b.join(c, "key", "full").select("key", state.alias("state")).where("state is not null")


def newest(sessions: DataFrame, k: int = 40, key: str = "actor") -> DataFrame:
    """The k sessions of each key that end last (then start last); each task keeps its own k before the shuffle."""
    from pyspark.sql import Window as W

    order = W.partitionBy(key).orderBy(F.desc("end"), F.desc("start"))
    return sessions.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def attribute(changes: DataFrame, sessions: DataFrame, slack: int = 900) -> DataFrame:
    """Each change (id, actor, ts) with the newest session (actor, start, end) whose span, widened by slack, holds it.

    A session stands in the one or two slices of time that it touches, in slices at least as long as itself, which double
    from an hour on; a change looks into one slice of each length that occurs. So long sessions cost no more than short
    ones, and the range condition meets few rows. Sessions that end before they start, and rows without actor or time,
    meet nothing; a change in no session has nulls."""
    wide = sessions.select("actor", "start", "end", (F.col("start") - slack).alias("__a"), (F.col("end") + slack).alias("__b")).where("__b >= __a")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("__b") - F.col("__a") + 1) / 3600))).cast("int")
    wide = wide.withColumn("__level", level)
    floored = lambda c: F.expr(f"({c} - pmod({c}, 3600 * shiftleft(1L, __level))) div (3600 * shiftleft(1L, __level))")
    levels = [r[0] for r in wide.select("__level").distinct().collect()]  # at most a few dozen lengths
    near = wide.withColumn("__slice", F.explode(F.sequence(floored("__a"), floored("__b")))).drop("__a", "__b")
    asked = changes.select("id", "actor", "ts", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("__level"))
    hit = asked.withColumn("__slice", floored("ts")).join(near, ["actor", "__level", "__slice"])
    hit = hit.where((F.col("ts") >= F.col("start") - slack) & (F.col("ts") <= F.col("end") + slack))
    best = hit.groupBy("id").agg(F.max(F.struct("end", "start")).alias("s"))
    return changes.join(best, "id", "left").select("id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"))


def capability(execute: Column, persist: Column, propagate: Column) -> tuple[Column, Column]:
    """Score and band of three links from 0 to 10; a link below 3 breaks the loop and holds the score at 4."""
    top, low = F.greatest(execute, persist, propagate), F.least(execute, persist, propagate)
    score = F.when(low < 3, F.least(F.lit(4), top)).otherwise(F.bround((execute + persist + propagate) / 3).cast("int"))
    return score, F.when(score >= 8, "severe").when(score >= 6, "high").when(score >= 4, "moderate").when(score >= 2, "limited").otherwise("contained")


def safe(findings: DataFrame, content: str, path: str, withheld: str = "INJ-003") -> DataFrame:
    """Findings as hashes and places; one rule is counted but not shown."""
    shown = findings.where(F.col("rule_id") != withheld)
    return shown.select("rule_id", "severity", "line", F.sha2(F.col(content), 256).alias("content_hash"), F.sha2(F.col(path).cast("string"), 256).alias("path_hash"))


def co_occurrence(found: DataFrame, key: str, top: int = 8) -> DataFrame:
    """The `top` pairs of rules that fire together: rules per text are few, so pairs are made inside a row."""
    sets = found.groupBy(key).agg(F.array_sort(F.collect_set("rule_id")).alias("r"))
    pairs = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").count().orderBy(F.desc("count"), "a", "b").limit(top)


def alert_load(found: DataFrame, sampled: DataFrame, daily: int) -> DataFrame:
    """rule_id, n, per_day: linear extrapolation of a sample to `daily` texts; an empty sample gives no rows."""
    n = sampled.agg(F.count("*").alias("sampled"))
    return found.groupBy("rule_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("rule_id", "n", F.round(F.col("n") * daily / F.col("sampled"), 1).alias("per_day"))


def escalated(severity: Column, closed: Column, score: Column) -> Column:
    """One step worse where the loop of capabilities is closed and severe."""
    order = F.array(*[F.lit(x) for x in ("info", "low", "medium", "high", "critical")])
    at = F.array_position(order, severity)
    return F.when(closed & (score >= 8) & (at > 0), F.element_at(order, F.least(at + 1, F.lit(5)).cast("int"))).otherwise(severity)


def excise(df: DataFrame, text: str, pattern: str, passes: int = 5) -> DataFrame:
    """Cuts the paragraphs in which a pattern matches; adds clean and excised. What is left has the same paragraphs when it
    is split again, so one pass does what more would do; a match across paragraphs stays and is not clean."""
    found = lambda t: F.lower(t).rlike(L.quick(pattern))
    out = once(df, "excised", F.coalesce(F.col(text), F.lit("")))
    if passes:
        kept = F.filter(F.split("excised", "\n[ \t]*\n"), lambda p: ~found(p))
        out = once(out.withColumn("__kept", F.array_join(kept, "\n\n")).drop("excised"), "excised", F.col("__kept")).drop("__kept")
    return out.withColumn("clean", ~found(F.col("excised")))
