"""Mixing sources to target weights by entropy balancing.

Sources, ascending by code point with null last, take the weights of WEIGHTS in turn and share SHARE of all words. A
target stops at CAP times its source's words; the excess is dealt again by weight among the others, until none is above.

Among all document rates r in [0, CAP] that meet the sources' word constraints, the ones nearest to 1 in relative entropy
solve a convex dual with one multiplier per source: r = min(CAP, exp(multiplier * size / mean size)). Newton rounds find
it: each is one aggregate over all documents that gives gradient and curvature per source, with a bracket as safeguard.
Rates become whole copies: a hash of doc_id and text decides where a rate's fraction counts as a copy, shifted per source so that
the words taken come nearest to the target. Large documents are settled first and smaller ones make up what is left.

A document's size is its number of words, runs without space and \\t..\\r (null and empty: 0); such a document takes 0
words and gets one copy if its rate is at least 1. Rows without an id, or that share one, are told apart by their texts; rows that are equal in both share their fate, so a
source in which such rows hold much of the words can miss its target by half of them. Reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import join_small, settle

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.0, 3
#: Newton rounds at most, and the relative distance from the target that ends them.
ROUNDS, CLOSE = 20, 1e-4
#: Documents are settled in tiers by size over the source's mean; hash ranges of one tier that are summed first.
TIERS, BINS = (1.0, 0.25, 0.0), 4096


def targets(sources: DataFrame) -> DataFrame:
    """source, words, docs -> the same with target. Window functions over one row per source, not over documents."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    ranked = settle(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank - 1) % len(WEIGHTS) + 1)), "sources")
    # water level: sources are full in ascending order of CAP * words / weight
    order = W.orderBy((F.lit(float(CAP)) * F.col("words") / F.col("weight")), "weight", F.col("source").isNull(), "source")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    left = F.lit(SHARE) * F.sum("words").over(whole) - F.coalesce(F.sum(F.col("words") * CAP).over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = F.col("words") * CAP <= F.col("level") * F.col("weight")
    leveled = ranked.withColumns({"level": left / weight_left, "seat": F.count("*").over(upto)}).withColumn("full", full)
    # full sources come first; the first that is not full fixes the level of itself and all after it
    stop = F.min(F.when(~F.col("full"), F.struct("seat", "level"))).over(whole)
    stopped = leveled.withColumn("stop", stop)
    most = (F.col("words") * CAP).cast("double")
    capped = F.col("stop").isNull() | (F.col("seat") < F.col("stop.seat"))
    target = F.when(capped, most).otherwise(F.least(F.col("stop.level") * F.col("weight"), most))
    return stopped.withColumn("target", target).drop("level", "full", "seat", "weight", "stop")


def rate(tilt: Column) -> Column:
    return F.when(F.col("pinned"), F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(50.0), tilt * F.col("size") / F.col("mean")))))


def solve(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """key, mean, target, pinned, tilt of each source."""
    start = aims.select("key", "target", "words", (F.col("words") / F.greatest(F.lit(1), F.col("full_docs"))).alias("mean"), (F.col("target") >= F.col("words") * CAP * (1 - 1e-12)).alias("pinned"))
    now = settle(start.withColumns({"tilt": F.when(F.col("words") > 0, F.log(F.greatest(F.col("target") / F.col("words"), F.lit(1e-9)))).otherwise(F.lit(0.0)), "low": F.lit(-1e9), "high": F.lit(1e9), "done": F.col("pinned") | (F.col("words") == 0)}), "dual")
    for _ in range(ROUNDS):
        if now.where(~F.col("done")).isEmpty():
            break
        open_ = now.where(~F.col("done")).select("key", "mean", "tilt", "pinned")
        r = rate(F.col("tilt"))
        sums = join_small(sizes.where("size > 0"), open_, ["key"], "inner").groupBy("key").agg(
            F.sum(r * F.col("size")).alias("taken"),
            F.sum(F.when(r < CAP, r * F.col("size") * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))).alias("slope"),
        )
        miss = F.col("taken") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        newton = F.greatest(F.col("tilt") - 4, F.least(F.col("tilt") + 4, newton))
        between = F.when((low > -1e8) & (high < 1e8), (low + high) / 2).when(miss < 0, F.col("tilt") + 1).otherwise(F.col("tilt") - 1)
        step = F.when(newton.isNotNull() & (newton > low) & (newton < high), newton).otherwise(between)
        hit = F.abs(miss) <= F.col("target") * CLOSE
        moved = now.join(sums, "key", "left").select("key", "target", "words", "mean", "pinned", F.when(F.col("done") | hit, F.col("tilt")).otherwise(step).alias("tilt"), F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), (F.col("done") | hit).alias("done"))
        now = settle(moved, "dual")
    return now.select("key", "target", "words", "mean", "pinned", "tilt")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds copies to rows that hold doc_id, mark, key and size; a decision of the row and its source's plan alone."""
    aimed = join_small(rows, plan, ["key"])
    r = rate(F.col("tilt"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("mark"), F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    fraction = r - F.floor(r)
    order = F.struct((draw - fraction).alias("v"), F.coalesce(F.col("doc_id"), F.lit(-1)).alias("d"), F.col("size").alias("s"), F.col("mark").alias("m"))
    tier = F.lit(0)
    for i, least in enumerate(TIERS):
        tier = F.when(F.col("size") >= F.col("mean") * least, F.least(tier, F.lit(i)) if i == 0 else F.when(F.col("size") >= F.col("mean") * TIERS[i - 1], tier).otherwise(F.lit(i))).otherwise(tier)
    return aimed.withColumns({"rate": r, "order": order, "tier": tier})


def round_off(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with, per tier, the last row (in hash order) that gets the extra copy: cut0, cut1, ..."""
    from pyspark.sql import Window as W

    for i in range(len(TIERS)):
        seen = with_copies(rows.where("size > 0"), plan)
        taken_before = F.lit(0)
        base = F.floor(F.col("rate")) * F.col("size")
        for j in range(i):
            taken_before = taken_before + F.when(F.col("tier") == j, base + F.when(F.col("order") <= F.col(f"cut{j}"), F.col("size")).otherwise(F.lit(0))).otherwise(F.lit(0))
        due = F.when(F.col("tier") > i, F.col("rate") * F.col("size")).otherwise(F.lit(0.0))
        own = F.when(F.col("tier") == i, base).otherwise(F.lit(0))
        extra = (F.col("tier") == i) & (F.col("rate") < CAP)
        slot = F.floor((F.col("order.v") + 1) / 2 * BINS).cast("int")
        cells = seen.groupBy("key", F.when(extra, slot).alias("slot")).agg(F.sum(taken_before + own).alias("sure"), F.sum(due).alias("due"), F.sum(F.when(extra, F.col("size")).otherwise(F.lit(0))).alias("words"), F.max("target").alias("target"))
        cells = settle(cells, "cells")
        need = cells.groupBy("key").agg((F.max("target") - F.sum("sure") - F.sum("due")).alias("need"))
        by_slot = W.partitionBy("key").orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
        reach = cells.where("slot is not null").withColumn("upto", F.sum("words").over(by_slot)).join(need, "key")
        # the hash range in which the sum passes what is needed, then its rows in order
        edge = reach.where("upto > need").groupBy("key").agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("below"), "need")).alias("e")).select("key", "e.*")
        edge = settle(edge, "edge")
        inside = join_small(seen.where(extra).withColumn("slot", slot), edge, ["key", "slot"], "inner")
        by_row = W.partitionBy("key").orderBy("order").rangeBetween(W.unboundedPreceding, W.currentRow)
        steps = inside.withColumn("sum", F.col("below") + F.sum("size").over(by_row))
        best = steps.groupBy("key").agg(F.min_by("order", F.struct(F.abs(F.col("sum") - F.col("need")), "order")).alias("at"), F.min(F.abs(F.col("sum") - F.col("need"))).alias("off"), F.max(F.abs(F.col("below") - F.col("need"))).alias("none"), F.max("slot").alias("slot"))
        start = F.struct((F.col("slot") / F.lit(BINS / 2.0) - 1 - 1e-12).alias("v"), F.lit(-2).cast("long").alias("d"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("m"))
        chosen = best.select("key", F.when(F.col("none") < F.col("off"), start).otherwise(F.col("at")).alias(f"cut{i}"))
        every = F.struct(F.lit(2.0).alias("v"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("m"))
        plan = settle(plan.join(chosen, "key", "left").withColumn(f"cut{i}", F.coalesce(f"cut{i}", every)), "plan")
    return plan


def copies() -> Column:
    """Whole copies of a row from with_copies() under a plan from round_off()."""
    extra = F.lit(False)
    for i in range(len(TIERS)):
        extra = F.when((F.col("tier") == i) & (F.col("size") > 0), F.col("order") <= F.col(f"cut{i}")).otherwise(extra)
    made = F.floor("rate") + F.when((F.col("rate") < CAP) & extra, F.lit(1)).otherwise(F.lit(0))
    return F.when(F.col("size") > 0, made).otherwise(F.when(F.coalesce("rate", F.lit(1.0)) >= 1, F.lit(1)).otherwise(F.lit(0))).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), size.alias("size"), F.xxhash64(text_col).alias("mark"))


def plan_mix(rows: DataFrame) -> DataFrame:
    """The plan of each source for rows of doc_id, source, key, size, mark (a hash of the text)."""
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("full_docs"))
    aims = settle(targets(sources), "targets")
    return round_off(rows, solve(rows, aims))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies for each row of docs."""
    rows = settle(sized(docs), "sizes")
    done = with_copies(rows, plan_mix(rows)).withColumn("copies", copies())
    return done.select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), F.round("rate", 9).alias("rate"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns; texts are not shuffled."""
    rows = settle(sized(docs), "sizes")
    plan = plan_mix(rows)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), size.alias("size"), F.xxhash64("text").alias("mark"))
    taken = with_copies(packed, plan).withColumn("copies", copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
