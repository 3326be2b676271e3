"""Whether a payment does what its quote says: signed authorizations and decoded instructions, each with three answers.

refuse beats abstain, and abstain (something that matters could not be read) is never allow. Signatures are not recovered
here: the recovered signer is a column of the input, null where recovery failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrel.functions.folds import address, chain_id, padded, whole_number

FINDING = "array<struct<code:string,severity:string>>"
#: Fixed values of the formats: types that grant standing authority, methods, programs and opcodes that may occur.
STANDING = ["permit", "permitsingle", "permitbatch", "permittransferfrom", "permitbatchtransferfrom", "approve", "approval", "setapprovalforall", "delegation", "sessionkey", "increaseallowance"]
LARGEST = "115792089237316195423570985008687907853269984665640564039457584007913129639935"
PROGRAMS = ["system", "token", "token-2022", "associated-token", "compute-budget", "memo", "lighthouse"]
TRANSFERS, DANGEROUS = ["transfer", "transferChecked"], ["approve", "approveChecked", "setAuthority", "burn", "burnChecked", "mintTo", "mintToChecked", "closeAccount", "revoke"]
MOVERS = ["createAccount", "transfer", "createAccountWithSeed", "withdrawNonceAccount", "transferWithSeed"]
DIRECTIVE = "(?i)(ignore (all|any|previous)|system ?:|you must|send (the|all|your) )"
PRICE_CAP, LIMIT = 10_000_000, 1_400_000


def kept(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def finding(when: Column, code: str, severity: str = "critical") -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def authorizations(df: DataFrame, domains: DataFrame, key: str, skew: int = 60) -> DataFrame:
    """key, decision, reason, codes of authorizations against quotes.

    df: quote network, asset, pay_to, amount, method; payload p_method, primary_type, permit_value, p_asset, p_from, p_to,
    p_value, valid_after, valid_before, nonce, signer, now. domains: chain, asset, verified, of which few exist. Steps that
    end the check come first; after the signer is known, findings add up. A nonce that an earlier row of the same account
    used (in order of now, then key) is a replay."""
    d = df.withColumns({"chain": chain_id(F.col("network")), "q_asset": address(F.col("asset")), "q_to": address(F.col("pay_to")), "q_value": whole_number(F.col("amount"))})
    known = domains.select(F.col("chain"), F.lower("asset").alias("q_asset"), "verified")
    d = d.join(known, ["chain", "q_asset"], "left")
    a = {c: address(F.col(f"p_{c}")) for c in ("asset", "from", "to")}
    value, after, before = (whole_number(F.col(c)) for c in ("p_value", "valid_after", "valid_before"))
    pt = F.lower("primary_type")
    permit = F.col("permit_value").isNotNull() & (whole_number(F.col("permit_value")).isNull() | (whole_number(F.col("permit_value")) == LARGEST))
    standing = (pt != "permitwitnesstransferfrom") & (pt.isin(STANDING) | (pt == "")) | (F.coalesce(pt, F.lit("")) != "permitwitnesstransferfrom") & permit
    unread = [("network", F.col("chain").isNull()), ("asset", F.col("q_asset").isNull()), ("payee", F.col("q_to").isNull()), ("amount", F.col("q_value").isNull())]
    fields = [("domain", ~F.coalesce("verified", F.lit(False))), ("fields", a["from"].isNull() | a["to"].isNull() | value.isNull() | after.isNull() | before.isNull() | F.col("nonce").isNull()), ("signature", F.col("signer").isNull())]
    contradicts = (F.col("method") != F.col("p_method")) & F.col("method").isNotNull() & F.col("p_method").isNotNull()
    first = W.partitionBy(a["from"], "nonce").orderBy("now", key)
    number = lambda x: padded(x)
    late = F.lit(skew)
    # the earliest step that ends the check
    stop = F.coalesce(
        *[F.when(c, F.struct(F.lit("abstain").alias("decision"), F.lit(r).alias("reason"), F.lit(None).cast(FINDING).alias("found"))) for r, c in unread],
        F.when(contradicts | (a["asset"].isNotNull() & (a["asset"] != F.col("q_asset"))), F.struct(F.lit("refuse").alias("decision"), F.lit("method or asset").alias("reason"), kept(finding(F.lit(True), "AUTH-03")).alias("found"))),
        F.when(F.lower("p_method") == "delegation", F.struct(F.lit("abstain").alias("decision"), F.lit("opaque method").alias("reason"), kept(finding(F.lit(True), "AUTH-10", "high")).alias("found"))),
        F.when(standing, F.struct(F.lit("refuse").alias("decision"), F.lit("standing authority").alias("reason"), kept(finding(F.lit(True), "AUTH-06")).alias("found"))),
        F.when(F.lower("p_method") == "permit2", F.struct(F.lit("abstain").alias("decision"), F.lit("method").alias("reason"), F.lit(None).cast(FINDING).alias("found"))),
        *[F.when(c, F.struct(F.lit("abstain").alias("decision"), F.lit(r).alias("reason"), F.lit(None).cast(FINDING).alias("found"))) for r, c in fields],
        F.when(F.lower("signer") != a["from"], F.struct(F.lit("refuse").alias("decision"), F.lit("signer").alias("reason"), kept(finding(F.lit(True), "AUTH-04")).alias("found"))),
    )
    now = F.col("now")
    found = kept(
        finding(a["to"] != F.col("q_to"), "AUTH-01"), finding(number(value) != number(F.col("q_value")), "AUTH-02"),
        finding((number((now + late).cast("string")) < number(after)) | ((before != "0") & (number((now - late).cast("string")) > number(before))), "AUTH-05", "high"),
        finding(F.col("seen") > 1, "AUTH-07", "high"),
    )
    d = d.withColumn("seen", F.when(F.col("nonce").isNotNull() & a["from"].isNotNull(), F.row_number().over(first)).otherwise(F.lit(1)))
    done = d.select(key, stop.alias("stop"), found.alias("more"))
    decision = F.when(F.col("stop").isNotNull(), F.col("stop.decision")).when(F.size("more") > 0, "refuse").otherwise("allow")
    codes = F.transform(F.coalesce(F.when(F.col("stop").isNotNull(), F.coalesce("stop.found", F.array().cast(FINDING))), F.col("more")), lambda f: f["code"])
    return done.select(key, decision.alias("decision"), F.coalesce("stop.reason", F.lit("")).alias("reason"), F.array_join(codes, ",").alias("codes"))


def payments(instructions: DataFrame, key: str) -> DataFrame:
    """key, decision, codes of payments given as decoded instructions, one a row: program, opcode, destination, amount
    (whole numbers as text), text, unit_limit, unit_price, and the quote's payee account and quoted amount on every row;
    program is null for instructions that could not be decoded. One aggregate per payment, combined before the shuffle."""
    token = F.col("program").isin("token", "token-2022")
    moves = token & F.col("opcode").isin(TRANSFERS)
    to_payee = moves & (F.col("destination") == F.col("payee"))
    off = lambda c: F.coalesce(c, F.lit(False))
    known = token & F.col("opcode").isin(*TRANSFERS, "syncNative", "initializeAccount")
    system = F.col("program") == "system"
    numbers = whole_number(F.col("amount"))
    flags = {
        "astray": moves & off(F.col("destination") != F.col("payee")), "unseen": moves & F.col("destination").isNull(), "paid": to_payee, "wrong": to_payee & off(padded(numbers) != padded(whole_number(F.col("quoted")))),
        "unread": to_payee & numbers.isNull(), "program": ~F.col("program").isin(PROGRAMS), "opcode": token & (F.col("opcode").isin(DANGEROUS) | ~known) | (F.col("program") == "associated-token") & (F.col("opcode") == "recoverNested"),
        "mover": system & F.col("opcode").isin(MOVERS), "directive": (F.col("program") == "memo") & F.col("text").rlike(DIRECTIVE),
        "other": system & ~F.col("opcode").isin(*MOVERS, "advanceNonce") | (F.col("program") == "associated-token") & ~F.col("opcode").isin("create", "createIdempotent", "recoverNested"), "opaque": F.col("program").isNull(),
    }
    fee = F.coalesce(F.max("unit_limit"), F.lit(LIMIT)) * F.coalesce(F.max("unit_price"), F.lit(0)) / 1_000_000
    per = instructions.groupBy(key).agg(*[F.count_if(off(c)).alias(n) for n, c in flags.items()], fee.alias("fee"), F.bool_or(whole_number(F.col("quoted")).isNull() | F.col("payee").isNull()).alias("quoteless"))
    n = F.col
    hard = kept(
        finding((n("astray") > 0) | (n("unseen") > 0), "PAY-001"), finding((n("paid") > 1) | (n("wrong") > 0), "PAY-002"), finding(n("program") > 0, "PAY-003"), finding(n("opcode") > 0, "PAY-006"),
        finding(n("mover") > 0, "PAY-007"), finding(n("directive") > 0, "PAY-008", "medium"), finding(n("other") > 0, "PAY-009"), finding(n("fee") > PRICE_CAP, "PAY-010"),
    )
    per = per.withColumn("f", hard)
    none = (n("paid") == 0) & ~F.exists("f", lambda f: f["severity"] == "critical")
    per = per.withColumn("f", F.when(none, F.concat("f", kept(finding(F.lit(True), "PAY-001")))).otherwise(n("f")))
    decision = F.when(n("quoteless") | (n("opaque") > 0) | (n("unread") > 0), "abstain").when(F.exists("f", lambda f: f["severity"] == "critical"), "refuse").otherwise("allow")
    return per.select(key, decision.alias("decision"), F.array_join(F.array_sort(F.array_distinct(F.transform("f", lambda f: f["code"]))), ",").alias("codes"))
