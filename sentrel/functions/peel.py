"""Layers of encoding under a text: base 64, hex and percent codes, round by round, each layer with the way to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.folds import percent

# Fewest characters of a token of each kind.
BASE64, HEX = "[A-Za-z0-9+/_-]{24,}", "(?:[0-9A-Fa-f]{2}){20,}"
CODE = "%[0-9A-Fa-f]{2}"
ROUNDS, LEAST = 3, 12


def readable(text: Column) -> Column:
    """The text, or null unless it is prose: LEAST characters, more than nine tenths of them printable ASCII, white space
    and three letters in a row."""
    plain = F.length(F.regexp_replace(text, "[^\\x20-\\x7E\\n\\t]", ""))
    prose = (F.length(text) >= LEAST) & (plain > 0.9 * F.length(text)) & text.rlike("[ \\t\\n\\r]") & text.rlike("[A-Za-z]{3}")
    return F.when(prose, text)


def from_bytes(raw: Column) -> Column:
    text = raw.cast("string")
    return readable(F.when(F.is_valid_utf8(text), text))


def from_base64(token: Column) -> Column:
    """Both alphabets, with or without padding; a length that no bytes have gives null."""
    whole = F.concat(F.translate(token, "-_", "+/"), F.repeat(F.lit("="), (4 - F.length(token) % 4) % 4))
    return from_bytes(F.when(F.length(token) % 4 != 1, F.try_to_binary(whole, F.lit("base64"))))


def layers_of(text: Column, way: Column) -> Column:
    """(via, body) of everything that one round decodes, null bodies included."""
    via = lambda kind: F.concat_ws("+", F.when(way != "", way), F.lit(kind)).alias("via")
    found = lambda pattern, kind, decode: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.struct(via(kind), decode(t).alias("body")))
    decoded = percent(text)
    whole = F.when(text.rlike(CODE) & (decoded != text), F.array(F.struct(via("percent"), decoded.alias("body"))))
    none = F.array().cast("array<struct<via:string,body:string>>")
    return F.concat(found(BASE64, "base64", from_base64), found(HEX, "hex", lambda t: from_bytes(F.unhex(t))), F.coalesce(whole, none))


def peeled(texts: DataFrame, keys: list[str], text: str, rounds: int = ROUNDS) -> DataFrame:
    """keys, depth, via, body: every different text that up to `rounds` decodings bring out of each row's text, with its
    shortest way (then the first by name); never the text itself, so what decodes to itself or to a layer before ends.

    All tokens of whole texts are tried. A layer is shorter than what it comes from, so a row has at most as many decoded
    characters a round as its text, twice over for digits that both kinds read. Only layers are shuffled, never the texts.
    Null and empty texts have no layers; rows must differ in their keys, else equal layers of equal keys count once."""
    df = texts.select(*keys, F.col(text).alias("__text"), F.lit("").alias("__via"), F.lit(0).alias("__depth"), F.sha2(F.col(text), 256).alias("__own"))
    df = df.where(F.col("__text").rlike(f"{BASE64}|{CODE}"))
    for depth in range(1, rounds + 1):
        below = F.when(F.col("__depth") == depth - 1, F.filter(layers_of(F.col("__text"), F.col("__via")), lambda x: x["body"].isNotNull() & (x["body"] != "")))
        here = F.struct(F.col("__via").alias("via"), F.col("__text").alias("body"))
        made = F.transform(F.coalesce(below, F.array().cast("array<struct<via:string,body:string>>")), lambda x: F.struct(F.lit(depth).alias("depth"), x.alias("x")))
        kept = F.when(F.col("__depth") > 0, F.array(F.struct(F.col("__depth").alias("depth"), here.alias("x")))).otherwise(F.array().cast("array<struct<depth:int,x:struct<via:string,body:string>>>"))
        df = df.select(*keys, "__own", F.explode(F.concat(kept, made)).alias("r")).select(*keys, "__own", F.col("r.x.body").alias("__text"), F.col("r.x.via").alias("__via"), F.col("r.depth").alias("__depth"))
    named = df.withColumn("__name", F.sha2("__text", 256)).where("__name <> __own")
    first = named.groupBy(*keys, "__name").agg(F.min(F.struct(F.col("__depth").alias("depth"), F.col("__via").alias("via"), F.col("__text").alias("body"))).alias("f"))
    return first.select(*keys, "f.depth", "f.via", "f.body")
