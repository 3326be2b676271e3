"""Quote texts: the leaves of a JSON quote, their views, eleven rules with the payees and hosts of the quote, a decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel import lexicon as L
from sentrel.functions import folds, peel
from sentrel.functions.textops import once, signs_of, window, with_firsts, with_signs
from sentrel.operators.rules import comments, hostile_comment
from sentrel.sources.sinks import rank

DEPTH, FIELD = 12, 65_536
#: Codes of phrases, which may be quoted; the others are about characters and fields.
QUOTABLE = ("QTX-01", "QTX-02", "QTX-03", "QTX-04", "QTX-07", "QTX-08", "QTX-09")
VIEWS = ["", "folded", "tags", "percent", "together"]
#: Keys whose values are identifiers, not prose.
IDENTIFIERS = ["scheme", "network", "asset", "payto", "amount", "nonce", "signature", "from", "to", "value", "version", "chainid", "salt", "decimals"]


def leaves(quotes: DataFrame, key: str, body: str, depth: int = DEPTH) -> DataFrame:
    """key, path, text, complete: the string leaves of JSON texts, whole. What stands deeper than `depth` levels is not read:
    its container is a row with an empty text and complete false, and so is a text that is no JSON (null as empty), which
    is one leaf itself. Empty strings, numbers, booleans and nulls are no leaves.

    A level is one generator over the rows that are left; leaves found early are carried along."""
    spark = quotes.sparkSession
    df = quotes.select(F.col(key).alias("__key"), F.coalesce(F.col(body), F.lit("")).alias("__body")).withColumn("__v", F.try_parse_json("__body"))
    df = df.select("__key", F.when(F.col("__v").isNull(), F.col("__body")).alias("__text"), "__v", F.lit("").alias("__path"), F.col("__v").isNull().alias("__done"))
    for _ in range(depth):
        inside = F.when(~F.col("__done"), F.col("__v"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("__path") != "", ".").otherwise(""), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        below = df.withColumn("__in", inside).lateralJoin(spark.tvf.variant_explode_outer(F.col("__in").outer()))
        child = F.col("pos").isNotNull()
        df = below.select("__key", "__text", F.when(child, F.col("value")).otherwise(F.col("__v")).alias("__v"), F.when(child, F.concat("__path", step)).otherwise(F.col("__path")).alias("__path"), (F.col("__done") | ~child).alias("__done"))
    kind = F.schema_of_variant("__v")
    cut = ~F.col("__done") & kind.rlike("^(OBJECT|ARRAY)") & ~kind.isin("OBJECT<>", "ARRAY<VOID>")
    found = df.withColumns({"__cut": F.coalesce(cut, F.lit(False)), "__leaf": F.when(kind == "STRING", F.try_variant_get("__v", "$", "string"))})
    bare = F.col("__v").isNull()
    kept = found.where(bare | F.col("__cut") | (F.col("__leaf") != ""))
    return kept.select(F.col("__key").alias(key), F.col("__path").alias("path"), F.coalesce("__text", "__leaf", F.lit("")).alias("text"), (~bare & ~F.col("__cut")).alias("complete"))


def sink(path: Column) -> Column:
    """Where a field's text ends up, by its path."""
    p = F.lower(path)
    tool = F.contains(p, F.lit("bazaar")) & (F.contains(p, F.lit("description")) | F.contains(p, F.lit("inputschema")))
    return F.when(tool, "tool").when(F.endswith(p, F.lit("memo")), "memo").when(F.contains(p, F.lit("description")), "description").when((p == "error") | F.endswith(p, F.lit(".error")), "error").otherwise("other")


def identifier(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), "([a-z0-9]+)(?:\\[[0-9]+\\])?$", 1).isin(IDENTIFIERS)


def views(fields: DataFrame) -> DataFrame:
    """Each field as it is, folded, with its tags spelled out, percent-decoded and with words put together; each text once.
    Adds view (0 for the field as it is), via (its name, empty for the field as it is) and body."""
    t = F.col("text")
    made = [t, folds.normalized(t), folds.hidden_tags(t), folds.percent(t), folds.together(folds.strip_wide(t))]
    listed = F.array(*[F.struct(F.lit(i).alias("view"), F.lit(VIEWS[i]).alias("via"), m.alias("body")) for i, m in enumerate(made)])
    fresh = F.aggregate(listed, F.array().cast("array<struct<view:int,via:string,body:string>>"), lambda a, x: F.when((x["body"] == "") & (x["view"] > 0) | F.exists(a, lambda y: y["body"] == x["body"]), a).otherwise(F.concat(a, F.array(x))))
    return once(fields, "__v", fresh).select("*", F.explode("__v").alias("v")).select("*", "v.*").drop("__v", "v")


def deep_views(fields: DataFrame) -> DataFrame:
    """views() and the layers that decoding brings out of each of them; view of a layer is 100 times its depth above that
    of the view it comes from, via the way to it. fields must differ in all columns but text, payees and hosts."""
    flat = views(fields)
    keys = [c for c in flat.columns if c not in ("text", "body")]
    layers = peel.peeled(flat.withColumnRenamed("via", "__base"), [("__base" if c == "via" else c) for c in keys], "body")
    named = layers.withColumns({"view": F.col("view") + 100 * F.col("depth"), "via": F.concat_ws("+", F.when(F.col("__base") != "", F.col("__base")), "via")})
    return flat.drop("text").unionByName(named.select(*keys, "body"))


def in_quotes(text: Column, at: Column) -> Column:
    """Whether a place stands within quotation marks or code: among the 400 characters before it an odd number of a mark
    that is its own end, or more curly openers than closers."""
    left = F.greatest(at - 400, F.lit(0))
    before = F.substring(text, left + 1, at - left)
    n = lambda mark: F.length(before) - F.length(F.replace(before, F.lit(mark), F.lit("")))
    return (n('"') % 2 == 1) | (n("'") % 2 == 1) | (n("`") % 2 == 1) | (n("\u201c") > n("\u201d"))


def scan_views(fields: DataFrame) -> DataFrame:
    """Adds findings (code, severity, at) to rows of path, view, body, payees (addresses in lower case), hosts.

    Commands to copy of which the seller speaks in the first person are none; harmless objects, descriptions, places within
    quotation marks and hosts that cannot be told make a finding high in place of critical."""
    df = fields.withColumn("__t", F.lower(F.substring(F.coalesce("body", F.lit("")), 1, FIELD)))
    near = lambda h, reach: window(h["near"], h["at"], h["at"] + h["e"] - h["p"], reach)
    foreign = lambda text: F.exists(F.regexp_extract_all(text, F.lit(L.ADDRESS), F.lit(0)), lambda a: ~F.array_contains("payees", a))

    def own(text: Column) -> Column:
        host = F.regexp_extract(text, "https?://([a-z0-9.-]+)", 1)
        return F.exists("hosts", lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))

    firsts = {
        "__copy": (L.SELF_REFERENCE, lambda h: near(h, 160).rlike(L.quick(L.COPY_VERB)) & near(h, 300).rlike(L.quick(L.COPY_TARGET)) & ~near(h, 60).rlike(L.quick(L.FIRST_PERSON))),
        "__over": (L.OVERRIDE, lambda h: F.lit(True)),
        "__exfil": (L.SECRET, lambda h: near(h, 200).rlike(L.quick(L.SEND_VERB)) & near(h, 300).rlike(L.DESTINATION) & ~near(h, 300).rlike(L.PLACEHOLDER) & ~own(near(h, 300))),
        "__quiet": (L.CONCEAL, lambda h: near(h, 250).rlike(L.quick(L.SECRET))),
        "__still": (L.CONCEAL, lambda h: near(h, 250).rlike(L.quick(L.SEND_VERB))),
        "__pay": (L.REDIRECT, lambda h: foreign(near(h, 200)) | near(h, 300).rlike(L.quick(L.SECOND))),
        "__role": (L.ROLE, lambda h: F.lit(True)),
    }
    df, place_of = with_signs(df, "__t", "__signs", [L.sign(p) for p, _ in firsts.values()])
    df = with_firsts(df, "__t", firsts, signs_of(firsts, place_of))
    t, raw, at = F.col("__t"), F.col("view") == 0, lambda n: F.col(f"__{n}")
    around = lambda n, reach: window(t, at(n), at(n), reach)
    told = lambda n: around(n, 120).rlike(L.quick(L.ATTRIBUTED)) | around(n, 120).rlike(L.quick(L.PROHIBITED)) | around(n, 120).rlike(L.quick(L.TOPIC))
    worse = lambda mild: F.when(mild, "high").otherwise("critical")
    harmless = around("copy", 300).rlike(L.quick(L.USER_OBJECT)) & ~around("copy", 300).rlike(L.quick(L.MESSAGE_NOUN))
    unsure = around("exfil", 300).rlike(L.MAILBOX) | (F.size("hosts") == 0)
    bare = F.regexp_replace("body", "\\x{1F3F4}[\\x{E0020}-\\x{E007E}]{1,16}\\x{E007F}", "")
    spot = lambda text, pattern: F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))))
    wide = folds.wide(F.col("body"))
    codes = [
        ("QTX-01", at("copy"), worse(harmless | told("copy"))), ("QTX-02", at("over"), worse(told("over"))), ("QTX-03", at("exfil"), worse(unsure)),
        ("QTX-04", F.when(F.contains(t, F.lit("<!--")) & F.exists(comments(t), lambda b: hostile_comment(b) | b.rlike(L.quick(L.REDIRECT))), F.instr(t, "<!--") - 1), F.lit("critical")),
        ("QTX-05", F.when(raw & wide, spot(F.col("body"), folds.INVISIBLE)), F.lit("high")), ("QTX-06", F.when(raw & wide, spot(bare, folds.TAGS)), F.lit("critical")),
        ("QTX-07", F.coalesce(at("quiet"), at("still")), worse(at("quiet").isNull())), ("QTX-08", at("pay"), worse(sink(F.col("path")) == "error")), ("QTX-09", at("role"), worse(told("role"))),
        ("QTX-10", F.when(raw & (F.length("body") > FIELD), F.lit(FIELD)), F.lit("medium")), ("QTX-11", F.when(raw & identifier(F.col("path")) & ~F.col("body").rlike("^[A-Za-z0-9:._+/=-]{1,1024}$"), F.lit(0)), F.lit("high")),
    ]
    mild = lambda c, where, severity: F.when((severity == "critical") & in_quotes(t, where), "high").otherwise(severity) if c in QUOTABLE else severity
    made = [F.when(where.isNotNull(), F.struct(F.lit(c).alias("code"), mild(c, where, severity).alias("severity"), where.alias("at"))) for c, where, severity in codes]
    return df.withColumn("findings", F.filter(F.array(*made), lambda f: f.isNotNull())).drop("__t", "__signs", *firsts)


def quote_findings(fields: DataFrame, *keys: str) -> DataFrame:
    """One row per field and code over all views: keys, path, sink, code, severity, at, view and via of the first view that shows it."""
    found = scan_views(deep_views(fields)).select(*keys, "path", "view", "via", F.explode("findings").alias("f"))
    first = found.groupBy(*keys, "path", "f.code").agg(F.min(F.struct("view", "via", "f.severity", "f.at")).alias("b"))
    return first.select(*keys, "path", sink(F.col("path")).alias("sink"), "code", "b.severity", "b.at", "b.view", "b.via")


def sorted_findings(found: DataFrame, *keys: str) -> DataFrame:
    """keys and findings as an array, the worst first, then by the authority of the sink, then by path and code."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("tool", "memo", "description", "error", "other")]), F.col("sink"))
    row = F.struct(rank(F.col("severity")).alias("rank"), order.alias("order"), "path", "code", "severity", "sink")
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("f"))
    return listed.select(*keys, F.transform("f", lambda f: F.struct(f["code"].alias("code"), f["severity"].alias("severity"), f["sink"].alias("sink"), f["path"].alias("path"))).alias("findings"))


def decisions(quotes: DataFrame, found: DataFrame, key: str, ignored: tuple = ()) -> DataFrame:
    """key, decision, codes for each row of quotes (key, complete): refuse on a critical finding; abstain where a quote was
    not read whole or a field was cut; else allow. Ignored codes decide nothing."""
    kept = found.where(~F.col("code").isin(*ignored)) if ignored else found
    per = kept.groupBy(key).agg(F.bool_or(F.col("severity") == "critical").alias("bad"), F.array_sort(F.collect_set("code")).alias("codes"))
    whole = quotes.groupBy(key).agg(F.bool_and("complete").alias("complete")).join(per, key, "left")
    cut = ~F.col("complete") | F.coalesce(F.array_contains("codes", "QTX-10"), F.lit(False))
    decision = F.when(F.coalesce("bad", F.lit(False)), "refuse").when(cut, "abstain").otherwise("allow")
    return whole.select(key, decision.alias("decision"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def redacted(df: DataFrame, text: str, lines: str, mark: str = "[removed]") -> DataFrame:
    """Adds redacted, the text with the lines (numbers from 1 in an array column) replaced by a mark."""
    parts = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.array_contains(lines, (i + 1).cast("long")), F.lit(mark)).otherwise(x))
    return df.withColumn("redacted", F.array_join(parts, "\n"))


def pending(calls: DataFrame, body: str = "input") -> DataFrame:
    """Adds pending, what a tool call (JSON text) would write: its content, or its new strings joined; null where it writes
    nothing that can be read."""
    v = F.try_parse_json(body)
    edits = F.transform(F.try_variant_get(v, "$.edits", "array<variant>"), lambda e: F.try_variant_get(e, "$.new_string", "string"))
    text = F.coalesce(F.try_variant_get(v, "$.content", "string"), F.try_variant_get(v, "$.new_string", "string"), F.array_join(F.filter(edits, lambda e: e.isNotNull()), "\n"))
    return calls.withColumn("pending", text)


def order_fields(v: Column) -> Column:
    """symbol, side, notional, quantity of a call's arguments (a variant), from the first present of the usual names."""
    get = lambda kind, *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])
    side = F.when(F.contains(F.lower(get("string", "side", "action", "direction", "type")), F.lit("sell")), "sell").when(v.isNotNull(), "buy")
    fields = {"symbol": F.upper(get("string", "symbol", "ticker", "instrument", "asset")), "side": side, "notional": get("double", "notionalUsd", "notional", "amountUsd", "usd"), "quantity": get("double", "quantity", "qty", "size", "shares")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def order_of(calls: DataFrame, body: str = "arguments") -> DataFrame:
    """Adds order (symbol, side, notional, quantity) of a tool call's JSON arguments, from the first present of the usual
    names; null symbol and side where the arguments cannot be read."""
    kept = [calls[c] for c in calls.columns if c != "order"]
    return once(calls, "__given", F.try_parse_json(body)).select(*kept, order_fields(F.col("__given")).alias("order"))


def any_of(column: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(w)) for w in words])
