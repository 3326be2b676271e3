"""Named queries over guarded messages, receipts, requirements, billing and binary fields, and their SQL. The tables hold no
messages, so these are written from their rows by remainders of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel import lexicon as L
from sentrel.functions.binary import HALF, little_endian, normal_signature
from sentrel.operators import exchange, receipts
from sentrel.oracle import EVENTS, q
from sentrel.host_queries import pick
from sentrel.queries import events, table

_TOOLS = ["place_order", "get_news", "quick_BUY_now", "cancel", "submit_order_v2"]
_SYMBOLS = ["btc", "ETH", "doge"]
_MOST = 150_000
_KEY = b"0123456789abcdef"


def rpc_requests(spark, d):
    """o_orderkey, customer, at, body: each order as a call of a tool; some list tools, are cut off, or lack a symbol or an amount."""
    k = F.col("o_orderkey")
    usd = F.floor("o_totalprice").cast("string")
    symbol = F.when(k % 7 == 0, F.lit('"note":1')).otherwise(F.concat(F.lit('"ticker":"'), pick(_SYMBOLS, k), F.lit('"')))
    amount = F.when(k % 5 == 1, F.lit('"qty":3')).otherwise(F.concat(F.lit('"usd":'), usd))
    method = F.when(k % 11 == 0, "tools/list").otherwise("tools/call")
    body = F.concat(F.lit('{"jsonrpc":"2.0","id":'), k.cast("string"), F.lit(',"method":"'), method, F.lit('","params":{"name":"'), pick(_TOOLS, k), F.lit('","arguments":{'), symbol, F.lit(","), amount, F.lit("}}}"))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"), F.when(k % 13 == 0, F.substring(body, 1, 30)).otherwise(body).alias("body"))


def request_answers(spark, d):
    out = exchange.requests(rpc_requests(spark, d), allowed=["BTC", "eth"], most=float(_MOST))
    return out.select("o_orderkey", "tool", F.col("order.symbol").alias("symbol"), F.col("order.notional").cast("long").alias("usd"), "code", F.sha2("answer", 256).alias("answer"))


def request_caps(spark, d):
    """The orders of each customer held against a total of 60 days too."""
    out = exchange.capped(exchange.requests(rpc_requests(spark, d), most=1e9), "customer", "at", daily=200_000.0, seconds=60 * 86_400)
    return out.select("o_orderkey", "customer", "code")


def response_notes(spark, d):
    """Documents as answers of two blocks: the whole text, and the text of a quote that the id picks behind its first 200 characters."""
    said = F.get(F.array(*[F.lit(x[1]) for x in L.QUOTES]), (F.col("doc_id") % len(L.QUOTES)).cast("int"))
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    content = F.array(block(F.col("text")), block(F.concat(F.substring("text", 1, 200), F.lit("\n"), said)))
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.struct(content.alias("content")).alias("result")))
    out = exchange.answers(table(spark, d, "documents").select("doc_id", body.alias("body")), ["doc_id"])
    blocks = F.size(F.try_variant_get(F.try_parse_json("annotated"), "$.result.content", "array<variant>"))
    return out.select("doc_id", F.array_join("codes", ",").alias("codes"), F.when(F.col("annotated").isNotNull(), blocks).alias("blocks"))


def _payment_requests(spark, d, payee: str):
    k = F.col("o_orderkey")
    quoted = lambda n, x: F.concat(F.lit(f'"{n}":"'), x.cast("string"), F.lit('"'))
    quote = F.concat(F.lit('{"memo":"thanks",'), quoted("payTo", F.concat(F.lit(payee), F.col("o_custkey"))), F.lit(',"asset":null,'), quoted("amount", F.floor("o_totalprice")), F.lit("}"))
    nested = F.concat(F.lit('{"authorization":{'), quoted("from", k), F.lit(","), quoted("to", F.col("o_custkey")), F.lit(',"value":7},"signature":"0x1f"}'))
    flat = F.concat(F.lit('{"to":"me",'), quoted("amount", k), F.lit(',"more":[1]}'))
    payload = F.when(k % 4 == 0, nested).when(k % 4 == 1, flat).when(k % 4 == 2, F.concat(F.lit('"raw '), k, F.lit('"')))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("network"), F.when(k % 17 == 0, F.lit("{")).otherwise(quote).alias("quote"), payload.alias("payload"))


def request_digests(spark, d):
    r = _payment_requests(spark, d, "c")
    return r.select("o_orderkey", receipts.request_digest(F.col("network"), F.col("quote"), F.col("payload")).alias("digest"))


def receipt_checks(spark, d):
    """Receipts of orders: some for another payee, without a digest or request, of another version, altered after signing."""
    k = F.col("o_orderkey")
    there, other = _payment_requests(spark, d, "c"), _payment_requests(spark, d, "x")
    digest = lambda r: receipts.request_digest(r["network"], r["quote"], r["payload"])
    issued = there.where(k % 6 != 0).select("o_orderkey", digest(there).alias("request_digest")).unionByName(other.where(k % 6 == 0).select("o_orderkey", digest(other).alias("request_digest")))
    fields = {"v": F.when(k % 19 == 0, 2).otherwise(1), "decision": pick(["allow", "refuse", "abstain"], k), "codes": F.array(F.lit("QTX-01")), "amount_bucket": F.lit(None).cast("string"), "chain_id": k % 3, "lane": F.lit("evm"), "quote_provenance": F.lit("held"), "issued_at": F.lit("2024-01-01T00:00:00Z")}
    issued = receipts.signed(issued.withColumns(fields | {"request_digest": F.when(k % 9 != 0, F.col("request_digest"))}), _KEY)
    issued = issued.withColumns({"chain_id": F.when(k % 23 == 0, F.col("chain_id") + 1).otherwise(F.col("chain_id")), "signature": F.when(k % 29 == 0, "").when(k % 31 == 0, "*").otherwise(F.col("signature"))})
    judged = receipts.verified(issued, _KEY).select("o_orderkey", "problem", receipts.paid(F.when(k % 5 != 0, F.col("decision"))).alias("paid"))
    return receipts.replays(issued.select("o_orderkey", "request_digest"), there.where(k % 10 != 0), "o_orderkey").join(judged, "o_orderkey").select("o_orderkey", "state", "problem", "paid.*")


def requirement_quotes(spark, d):
    """A payment requirement for each customer, some fields absent or of another kind, and a quote with its text."""
    k = F.col("c_custkey")
    text = lambda n, x, absent, odd: F.when(k % odd == 0, F.lit(f'"{n}":7')).when(k % absent != 0, F.concat(F.lit(f'"{n}":"'), x, F.lit('"')))
    body = F.concat(F.lit("{"), F.concat_ws(",", text("network", F.lit("base"), 3, 10), text("payTo", F.col("c_name"), 4, 11), text("asset", F.lit("usd"), 5, 12), text("amount", k.cast("string"), 2, 13), text("maxAmountRequired", F.lit("900"), 7, 14), text("memo", F.col("c_mktsegment"), 6, 15), text("note", F.col("c_name"), 8, 16)), F.lit("}"))
    body = F.when(k % 17 == 0, F.lit('"plain words"')).when(k % 18 == 0, F.lit("[]")).otherwise(body)
    r = table(spark, d, "customer").select(k, body.alias("body")).withColumn("r", receipts.requirement(F.col("body")))
    return r.select("c_custkey", "r.*", receipts.quote_text(F.col("body")).alias("text"), receipts.quote_amount(F.col("body")).alias("stated"))


def metered_events(spark, d):
    """Events as checks whose quotes come from four kinds of sources, in three tiers; amount and price by caller and tier."""
    source = pick(receipts.BILLABLE + ["caller_asserted"], F.col("sender"))
    e = events(spark, d).select(F.col("tx").cast("string").alias("digest"), source.alias("provenance"), F.col("kind").alias("decision"), F.lit(1).alias("chain_id"), F.col("ts").alias("issued_at"), F.lit(None).cast("string").alias("amount_bucket"), F.when(F.col("tx") % 3 == 0, "monthly").when(F.col("tx") % 3 == 1, "per_call").alias("tier"), F.when(F.col("sender") % 7 != 0, F.col("sender").cast("string")).alias("caller"))
    out = receipts.metered(e, {"merchant_signed": 1000})
    return out.groupBy("caller", "tier", "provenance").agg(F.count("*").alias("checks"), F.sum("price").alias("price"))


def binary_fields(spark, d):
    """Signatures in six forms and numbers with their least byte first, from order keys."""
    k = F.col("o_orderkey")
    r, s = F.lpad(F.hex(k), 64, "0"), F.lpad(F.hex("o_custkey"), 64, "0")
    high = F.lit(HALF[:-2] + "a1")  # the first s above the half
    forms = [F.concat(r, s, F.lit("1B")), F.concat(r, s, F.lit("01")), F.concat(r, s, F.lit("1d")), F.concat(r, F.lit("8"), F.substring(s, 2, 63)), F.concat(r, high, F.lit("1c")), F.concat(r, s, F.lit("1"))]
    sig = F.concat(F.lit("0x"), F.get(F.array(*forms), (k % 6).cast("int")))
    data = F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex(k), 16, "0")))
    number = lambda offset, width: little_endian(data, offset, width).cast("string")
    return table(spark, d, "orders").select("o_orderkey", normal_signature(sig).alias("sig"), number(1, 8).alias("u64"), number(5, 4).alias("u32"), number(6, 4).alias("beyond"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (request_answers, request_caps, response_notes, request_digests, receipt_checks, requirement_quotes, metered_events, binary_fields)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


_REASON = "CASE code " + " ".join(f"WHEN {q(c)} THEN {q(t)}" for c, t in exchange.REASONS.items()) + " END"
_DIGEST = """d AS (SELECT o_orderkey, o_orderkey % 17 = 0 AS broken, '{"network":"' || o_orderpriority || '","quote":{"payTo":"c' || o_custkey || '","asset":null,"amount":"' || floor(o_totalprice)::BIGINT || '"},"payload":' || CASE o_orderkey % 4
  WHEN 0 THEN '{"signature":"0x1f","to":"' || o_custkey || '","from":"' || o_orderkey || '","value":7,"validAfter":null,"validBefore":null,"nonce":null}'
  WHEN 1 THEN '{"signature":null,"to":"me","value":"' || o_orderkey || '","from":null}' WHEN 2 THEN '"raw ' || o_orderkey || '"' ELSE 'null' END || '}' AS body FROM orders)"""


def _field(name: str, value: str, absent: int, odd: int) -> str:
    return f"CASE WHEN k % 17 <> 0 AND k % 18 <> 0 AND k % {odd} <> 0 AND k % {absent} <> 0 THEN {value} END AS {name}"


SQL: dict[str, str] = {
    "request_answers": f"""WITH m AS (SELECT o_orderkey, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS call, {_list(_TOOLS)}[o_orderkey % 5 + 1] AS name, CASE WHEN o_orderkey % 7 <> 0 THEN upper({_list(_SYMBOLS)}[o_orderkey % 3 + 1]) END AS s,
  CASE WHEN o_orderkey % 5 <> 1 THEN floor(o_totalprice)::BIGINT END AS n FROM orders),
 o AS (SELECT *, call AND name IN ('place_order', 'quick_BUY_now', 'submit_order_v2') AS mine FROM m),
 c AS (SELECT *, CASE WHEN NOT mine THEN NULL WHEN s IS NULL THEN 'RPC-000' WHEN s = 'DOGE' THEN 'RPC-003' WHEN n IS NULL THEN 'RPC-004' WHEN n > {_MOST} THEN 'RPC-001' END AS code FROM o)
 SELECT o_orderkey, CASE WHEN call THEN name END AS tool, CASE WHEN mine THEN s END AS symbol, CASE WHEN mine THEN n END AS usd, code,
  sha256('{{"jsonrpc":"2.0","id":' || o_orderkey || ',"result":{{"content":[{{"type":"text","text":"Refused before it reached the tool: ' || {_REASON} || '. The limit is the operator''s and nothing that was read changes it."}}],"isError":true}}}}') AS answer FROM c""",
    "request_digests": f"WITH {_DIGEST} SELECT o_orderkey, CASE WHEN NOT broken THEN sha256(body) END AS digest FROM d",
    "receipt_checks": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 17 = 0 THEN 'no digest' WHEN o_orderkey % 10 = 0 THEN 'no request' WHEN o_orderkey % 6 = 0 THEN 'mismatch' ELSE 'match' END AS state,
 CASE WHEN o_orderkey % 19 = 0 THEN 'version' WHEN o_orderkey % 29 = 0 THEN 'missing' WHEN o_orderkey % 31 = 0 THEN 'unreadable' WHEN o_orderkey % 23 = 0 THEN 'signature' END AS problem,
 o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AS allow, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 2 THEN 'abstain' WHEN o_orderkey % 3 = 0 THEN 'allow' ELSE 'refuse' END AS decision FROM orders""",
    "requirement_quotes": f"""WITH c AS (SELECT *, c_custkey AS k FROM customer),
 f AS (SELECT k, {_field("network", "'base'", 3, 10)}, {_field("pay_to", "c_name", 4, 11)}, {_field("asset", "'usd'", 5, 12)}, {_field("a", "k::VARCHAR", 2, 13)}, {_field("m", "'900'", 7, 14)}, {_field("memo", "c_mktsegment", 6, 15)}, {_field("note", "c_name", 8, 16)} FROM c)
 SELECT k AS c_custkey, network, pay_to, asset, coalesce(a, m) AS amount, pay_to IS NOT NULL AND asset IS NOT NULL AND m IS NOT NULL AS "plain", pay_to IS NOT NULL AND asset IS NOT NULL AND network IS NOT NULL AND coalesce(a, m) IS NOT NULL AS "full",
 CASE WHEN k % 17 = 0 THEN 'plain words' WHEN memo IS NOT NULL OR note IS NOT NULL THEN concat_ws(chr(10), memo, note) END AS text, CASE WHEN k % 17 <> 0 AND k % 18 <> 0 AND k % 13 = 0 THEN '7' ELSE a END AS stated FROM f""",
    "metered_events": f"""WITH {EVENTS}, m AS (SELECT *, {_list(receipts.BILLABLE)}[sender % 4 + 1] AS provenance, CASE WHEN tx % 3 = 0 THEN 'monthly' ELSE 'per_call' END AS tier FROM e WHERE sender % 4 <> 3)
 SELECT CASE WHEN sender % 7 = 0 THEN 'unknown' ELSE sender::VARCHAR END AS caller, tier, provenance, count(*) AS checks, sum(CASE WHEN tier = 'monthly' THEN 0 WHEN provenance = 'merchant_signed' THEN 1000 ELSE 3000 END)::BIGINT AS price FROM m GROUP BY ALL""",
    "binary_fields": """WITH s AS (SELECT o_orderkey AS k, o_custkey AS n, lpad(lower(hex(o_orderkey)), 64, '0') AS r, lpad(lower(hex(o_custkey)), 64, '0') AS s FROM orders)
 SELECT k AS o_orderkey, CASE WHEN k > 0 AND n > 0 THEN CASE k % 6 WHEN 0 THEN '0x' || r || s || '1b' WHEN 1 THEN '0x' || r || s || '1c' WHEN 3 THEN '0x' || r || s || '1c' END END AS sig,
 ((k % 256)::HUGEINT * 72057594037927936 + (k // 256 % 256)::HUGEINT * 281474976710656 + (k // 65536 % 256)::HUGEINT * 1099511627776 + (k // 16777216 % 256)::HUGEINT * 4294967296)::VARCHAR AS u64,
 ((k % 256) * 16777216 + (k // 256 % 256) * 65536 + (k // 65536 % 256) * 256 + k // 16777216 % 256)::VARCHAR AS u32, NULL::VARCHAR AS beyond FROM s""",
}
