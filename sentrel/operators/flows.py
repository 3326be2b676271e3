"""Signals over transfers: fan-out, sweeps, fresh approvals, convergence, canaries. Times are seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.operators.windows import moving_counts
from sentrel.sources.work import settled


def narrow(transfers: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """Transfers of senders with a known past (facts: address, counterparties) of at most `most` counterparties; a sender
    of whom nothing is known shows no contrast and is left out."""
    known = facts.where(F.col("counterparties") <= most).select(F.col("address").alias("sender"))
    return transfers.join(known, "sender", "left_semi")


def young(transfers: DataFrame, facts: DataFrame, column: str, seconds: int) -> DataFrame:
    """Transfers whose address in a column is a contract with a complete history (facts: address, first_seen, contract,
    complete) that began at most `seconds` before."""
    f = facts.where("contract and complete").select(F.col("address").alias(column), "first_seen")
    age = F.col("ts") - F.col("first_seen")
    return transfers.join(f, column).where((age >= 0) & (age < seconds)).drop("first_seen")


def fan_out(transfers: DataFrame, seconds: int = 600, least: int = 10) -> DataFrame:
    """sender, ts, recipients: each sender's first transfer whose trailing window has `least` different recipients. Take
    narrow() transfers for senders with a narrow past only."""
    counts = moving_counts(transfers.where("recipient <> sender"), ["sender"], "recipient", seconds, 0)
    fired = counts.withColumnRenamed("different", "recipients").where(F.col("recipients") >= least)
    return fired.groupBy("sender").agg(F.min(F.struct("ts", "recipients")).alias("f")).select("sender", "f.*")


def sweep(transfers: DataFrame, balances: DataFrame, share: float = 0.98, facts: DataFrame | None = None, seconds: int = 86_400) -> DataFrame:
    """sender, batch, moved, balance: batches that move at least `share` of a positive balance. Transfers and balances may
    have a token, which then is part of the key. With facts (address, first_seen, complete), only batches with a recipient
    whose complete history began at most `seconds` before (transfers then have recipient and ts)."""
    key = ["sender", "token"] if "token" in balances.columns else ["sender"]
    sums = [F.sum("amount").alias("moved")]
    if facts is not None:
        f = facts.where("complete").select(F.col("address").alias("recipient"), "first_seen")
        transfers = transfers.join(f, "recipient", "left")
        age = F.col("ts") - F.col("first_seen")
        sums.append(F.bool_or(F.coalesce((age >= 0) & (age < seconds), F.lit(False))).alias("fresh"))
    moved = transfers.groupBy(*key, "batch").agg(*sums)
    moved = moved.where("fresh") if facts is not None else moved
    return moved.join(balances, key).where((F.col("balance") > 0) & (F.col("moved") >= share * F.col("balance"))).select("sender", "batch", "moved", "balance")


def fresh_approval(approvals: DataFrame, facts: DataFrame, least: float, seconds: int = 3600) -> DataFrame:
    """Approvals of at least `least` to spenders first seen at most `seconds` before."""
    joined = approvals.join(facts, approvals.spender == facts.address)
    age = F.col("ts") - F.col("first_seen")
    return joined.where((F.col("amount") >= least) & (age >= 0) & (age < seconds)).select("tx", "owner", "spender", "amount", age.alias("age"))


def convergence(transfers: DataFrame, prior: DataFrame | None = None, seconds: int = 3600, least: int = 5) -> DataFrame:
    """recipient, ts, senders: each recipient's first window with `least` different senders. With prior pairs (a, b),
    senders count only if a fold in ascending order finds them unrelated to those already taken; windows are then looked
    at whenever the recipient has a transfer, one to itself included. Transfers without a time are left out."""
    if prior is None:
        counts = moving_counts(transfers.where("recipient <> sender"), ["recipient"], "sender", seconds, 0).where(F.col("different") >= least)
        fired = counts.select("recipient", "ts", F.col("different").alias("senders"))
    else:
        fired = unrelated(transfers, prior, seconds, least)
    return fired.groupBy("recipient").agg(F.min(F.struct("ts", "senders")).alias("f")).select("recipient", "f.*")


def unrelated(transfers: DataFrame, prior: DataFrame, seconds: int, least: int) -> DataFrame:
    """recipient, ts, senders: windows with `least` unrelated senders, a recipient's first one among them.

    Running sums count a window's senders, and those without a smaller friend, which the fold always takes. A window with
    `least` of these fires, and so does one with more than (least - 1) * (most + 1) senders, as a taken sender keeps at most
    `most` larger friends out. Only windows before a recipient's first such one, which are small, and that one are folded;
    the fold needs no more than the senders that have friends."""
    pairs = prior.where("a <> b").select(F.greatest("a", "b").alias("who"), F.least("a", "b").alias("friend")).distinct()
    bound, tied = pairs.select("who").distinct(), pairs.select("who").union(pairs.select("friend")).distinct()
    most = pairs.groupBy("friend").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    moves = transfers.where("recipient is not null").select("recipient", "ts", F.when(F.col("sender") != F.col("recipient"), F.col("sender")).alias("who"))
    counts = moving_counts(moves, ["recipient"], "who", seconds, 0).where(F.col("different") >= least).select("recipient", "ts", "different")
    always = moves.join(bound.select("who", F.lit(True).alias("bound")), "who", "left").select("recipient", "ts", F.when(F.col("bound").isNull(), F.col("who")).alias("who"))
    free = moving_counts(always, ["recipient"], "who", seconds, 0).select("recipient", "ts", F.col("different").alias("free"))
    times = counts.join(free, ["recipient", "ts"]).crossJoin(F.broadcast(most))
    times = settled(times.withColumn("sure", (F.col("free") >= least) | (F.col("different") > (least - 1) * (F.col("most") + 1))), "windows")
    asked = times.join(times.where("sure").groupBy("recipient").agg(F.min("ts").alias("until")), "recipient", "left").where("until is null or ts <= until")
    width = seconds + 1
    spots = asked.select("recipient", "ts", F.explode(F.array(*[F.floor(F.col("ts") / width) - back for back in (0, 1)])).alias("slice"))
    seen = moves.join(tied, "who", "left_semi").select("recipient", "who", F.col("ts").cast("long").alias("at")).withColumn("slice", F.floor(F.col("at") / width))
    inside = spots.join(seen, ["recipient", "slice"]).where((F.col("at") <= F.col("ts")) & (F.col("at") >= F.col("ts") - seconds)).select("recipient", "ts", "who").distinct()
    met = inside.join(pairs, "who").join(inside.withColumnRenamed("who", "friend"), ["recipient", "ts", "friend"])
    met = inside.join(met.groupBy("recipient", "ts", "who").agg(F.collect_set("friend").alias("friends")), ["recipient", "ts", "who"], "left")
    none = F.array().cast(met.schema["friends"].dataType)
    met = met.groupBy("recipient", "ts").agg(F.array_sort(F.collect_list(F.struct("who", F.coalesce("friends", none).alias("friends")))).alias("w"))
    taken = F.aggregate("w", none, lambda s, x: F.when(F.arrays_overlap(s, x["friends"]), s).otherwise(F.concat(s, F.array(x["who"]))))
    out = asked.join(met, ["recipient", "ts"], "left").withColumn("senders", F.col("different") - F.coalesce(F.size("w") - F.size(taken), F.lit(0)))
    return out.where(F.col("senders") >= least).select("recipient", "ts", "senders")


def canary_contact(transfers: DataFrame, canaries: DataFrame) -> DataFrame:
    """tx, direction, fingerprint: one row per transfer that touches a planted address, the recipient's side first. The
    address itself is not returned. Canary lists are small by nature; the planner broadcasts them when they are."""
    c = canaries.select("address", F.substring(F.sha2(F.col("address").cast("string"), 256), 1, 12).alias("fingerprint"))
    to, of = c.toDF("recipient", "fp_to"), c.toDF("sender", "fp_of")
    hit = transfers.join(to, "recipient", "left").join(of, "sender", "left").where("fp_to is not null or fp_of is not null")
    return hit.select("tx", F.when(F.col("fp_to").isNotNull(), "in").otherwise("out").alias("direction"), F.coalesce("fp_to", "fp_of").alias("fingerprint"))


def canary_report(transfers: DataFrame, canaries: DataFrame) -> DataFrame:
    """fingerprint, inbound, outbound: one row per canary (address; repeated and null ones count once and not at all) with
    the transfers that touch it, 0 for those that nothing touched. May be published: it holds no address, and the counts
    of rows are the counts of canaries."""
    planted = canaries.select("address").where("address is not null").distinct()
    hits = canary_contact(transfers, planted).groupBy("fingerprint").agg(F.count_if(F.col("direction") == "in").alias("inbound"), F.count_if(F.col("direction") == "out").alias("outbound"))
    known = planted.select(F.substring(F.sha2(F.col("address").cast("string"), 256), 1, 12).alias("fingerprint"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return known.join(hits, "fingerprint", "left").select("fingerprint", zero("inbound"), zero("outbound"))
