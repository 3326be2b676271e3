"""Requests to verify a payment, the receipts issued for them, what is billed for it, and what may be paid.

JSON arrives as texts. Nothing here raises on what it is given: a text that cannot be read gives null, false or a named
problem. Digests are those of compact JSON with fixed fields in fixed order, nulls written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.textops import hmac_sha256

#: Sources of a quote that make a check billable, and the price of a check in millionths.
BILLABLE = ["independent_fetch", "merchant_signed", "facilitator_held"]
PER_CALL = 3000
#: The fields of a receipt, in order; those of an authorization that a digest binds; those of a quote that
#: hold text.
RECEIPT = "v decision codes amount_bucket chain_id lane quote_provenance request_digest issued_at".split()
BOUND = "to from value validAfter validBefore nonce".split()
TEXTS = "description memo note resource extra".split()

_json = {"ignoreNullFields": "false"}


def _at(v: Column, *names: str) -> Column:
    """The first of the named fields of an object that is neither absent nor null, as a variant."""
    found = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])


def _text(v: Column, *names: str) -> Column:
    """The first of the named fields that is a text."""
    found = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")) for x in found])


def _object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def request_digest(network: Column, quote: Column, payload: Column) -> Column:
    """SHA-256 of what decides a request's verdict: the network, payee, asset and amount of the quote, and of the payload the
    authorization's fields with its signature (or the top fields of a flat payload, or a text as it is). Free text does not
    count. Null if quote or payload is no JSON (null texts are JSON null)."""
    q, p = (F.try_parse_json(F.coalesce(x, F.lit("null"))) for x in (quote, payload))
    plain = lambda v: F.when(~F.is_variant_null(v), v)
    terms = F.to_json(F.struct(*[_at(q, n).alias(n) for n in ("payTo", "asset", "amount")]), _json)
    auth = F.try_variant_get(p, "$.authorization", "variant")
    nested = F.to_json(F.struct(_at(p, "signature").alias("signature"), *[_at(auth, n).alias(n) for n in BOUND]), _json)
    flat = F.to_json(F.struct(_at(p, "signature").alias("signature"), _at(p, "to").alias("to"), _at(p, "value", "amount").alias("value"), _at(p, "from").alias("from")), _json)
    other = lambda v: F.coalesce(F.to_json(plain(v)), F.lit("null"))
    parts = [
        F.to_json(F.struct(network.alias("network")), _json), F.lit(',"quote":'), F.when(_object(q), terms).otherwise(other(q)),
        F.lit(',"payload":'), F.when(_object(auth), nested).when(_object(p), flat).otherwise(other(p)), F.lit("}"),
    ]
    parts[0] = F.regexp_replace(parts[0], "[}]$", "")
    return F.when(q.isNotNull() & p.isNotNull(), F.sha2(F.concat(*parts), 256))


def canonical(fields: list[str] | None = None) -> Column:
    """The JSON of a receipt that is signed, from columns named as its fields."""
    return F.to_json(F.struct(*(fields or RECEIPT)), _json)


def signed(receipts: DataFrame, key: bytes) -> DataFrame:
    """Adds signature, in base 64: a keyed hash, as no library for signatures by key pairs is at hand."""
    return receipts.withColumn("signature", F.base64(F.unhex(hmac_sha256(canonical(), key))))


def verified(receipts: DataFrame, key: bytes) -> DataFrame:
    """Adds problem, why a receipt's signature does not hold (null if it does): version, missing, unreadable or signature."""
    raw = F.try_to_binary("signature", F.lit("base64"))
    holds = F.hex(raw) == F.upper(hmac_sha256(canonical(), key))
    problem = (
        F.when(F.col("v").isNull() | (F.col("v") != 1), "version").when(F.coalesce(F.col("signature"), F.lit("")) == "", "missing")
        .when(raw.isNull() | (F.octet_length(raw) == 0), "unreadable").when(~holds, "signature")
    )
    return receipts.withColumn("problem", problem)


def replays(receipts: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """key, state of each receipt (key, request_digest) against the request of the same key (key, network, quote, payload):
    match, mismatch, no digest (null or empty), no request, or unreadable. Several requests of a key are judged each."""
    made = requests.select(F.col(key).alias("__key"), F.lit(True).alias("__there"), request_digest(F.col("network"), F.col("quote"), F.col("payload")).alias("__digest"))
    both = receipts.join(made, receipts[key] == F.col("__key"), "left")
    given = F.coalesce(F.col("request_digest"), F.lit(""))
    state = F.when(given == "", "no digest").when(F.col("__there").isNull(), "no request").when(F.col("__digest").isNull(), "unreadable").when(F.col("__digest") == given, "match").otherwise("mismatch")
    return both.select(receipts[key], state.alias("state"))


def requirement(body: Column) -> Column:
    """(network, pay_to, asset, amount, plain, full) of a payment requirement in JSON: amount from amount or
    maxAmountRequired; plain is whether payee, asset and maxAmountRequired are there as texts, full whether network, payee,
    asset and one of the amounts are."""
    v = F.try_parse_json(body)
    fields = {"network": _text(v, "network"), "pay_to": _text(v, "payTo"), "asset": _text(v, "asset"), "amount": _text(v, "amount", "maxAmountRequired")}
    base = fields["pay_to"].isNotNull() & fields["asset"].isNotNull()
    plain = base & _text(v, "maxAmountRequired").isNotNull()
    full = base & fields["network"].isNotNull() & fields["amount"].isNotNull()
    return F.struct(*[c.alias(n) for n, c in fields.items()], plain.alias("plain"), full.alias("full"))


def quote_text(quote: Column) -> Column:
    """The text that a quote in JSON puts before a reader: itself if it is a string, else its text fields by line; null if
    there is none."""
    v = F.try_parse_json(quote)
    held = F.filter(F.array(*[_text(v, n) for n in TEXTS]), lambda t: t.isNotNull())
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.size(held) > 0, F.array_join(held, "\n"))


def quote_amount(quote: Column) -> Column:
    """The amount of a quote in JSON as a text; null where there is none."""
    return F.try_variant_get(F.try_parse_json(quote), "$.amount", "string")


def paid(decision: Column) -> Column:
    """(allow, decision): only the decision allow is one; no decision, as when the verifier did not answer, abstains."""
    known = F.coalesce(decision, F.lit("abstain"))
    return F.struct((known == "allow").alias("allow"), known.alias("decision"))


def price(provenance: Column, tier: Column, prices: dict[str, int] | None = None, per_call: int = PER_CALL) -> Column:
    """Millionths for one check: nothing unless it is billable or where the tier is monthly, else the source's own price."""
    own = F.coalesce(*[F.when(provenance == n, F.lit(x).cast("long")) for n, x in (prices or {}).items()], F.lit(per_call).cast("long"))
    free = ~F.coalesce(provenance.isin(BILLABLE), F.lit(False)) | (F.coalesce(tier, F.lit("per_call")) == "monthly")
    return F.when(free, F.lit(0).cast("long")).otherwise(own)


def metered(events: DataFrame, prices: dict[str, int] | None = None, per_call: int = PER_CALL) -> DataFrame:
    """The billable events with the named fields only, so that no text of a request is stored, and price: digest, provenance,
    decision, chain_id, issued_at, amount_bucket, tier (per_call if null), caller (unknown if null)."""
    kept = events.where(F.col("provenance").isin(BILLABLE))
    tier = F.coalesce("tier", F.lit("per_call"))
    own = ["digest", "provenance", "decision", "chain_id", "issued_at", "amount_bucket"]
    return kept.select(*own, tier.alias("tier"), F.coalesce("caller", F.lit("unknown")).alias("caller"), price(F.col("provenance"), tier, prices, per_call).alias("price"))
