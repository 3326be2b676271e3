"""Views that put known payloads into the supplied tables, and the gate and variants of the cascade."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel import lexicon as L
from sentrel.functions.textops import entropy, inserted, longest_printable_run, strip_invisible
from sentrel.operators.rules import scan


def seeded(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, lang, payload_no, malicious, body: every document's whole text, and after its first 200 characters the payload
    that its id picks; and more columns of the table as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = len(L.PAYLOADS)
    texts, bad = F.array(*[F.lit(t) for t, _ in L.PAYLOADS]), F.array(*[F.lit(b) for _, b in L.PAYLOADS])
    no = (F.col("doc_id") % n).cast("int")
    body = inserted(F.col("text"), 200, F.concat(F.lit("\n"), F.get(texts, no), F.lit("\n")))
    return docs.select("doc_id", "lang", no.alias("payload_no"), F.get(bad, no).alias("malicious"), body.alias("body"), *more)


def gate(text: Column) -> Column:
    """Cheap text-ness decision: (passed, reason, run, entropy). Strange characters always pass, so that hiding is no way
    around the rules; high entropy never rejects."""
    share = F.length(F.regexp_replace(text, "[^\\x20-\\x7E\\x{A0}-\\x{FFFC}]", "")) / F.length(text)

    def decided(x: Column) -> Column:
        reason = (
            F.when(text.isNull() | (F.length(text) == 0), "reject:empty")
            .when(text.rlike(L.ZERO_WIDTH) | text.rlike(L.TAG_BLOCK), "pass:invisible")
            .when((F.length(text) < 24) & (share >= 0.85), "pass:short")
            .when(F.length(text) < 24, "reject:short")
            .when(x["run"] < 24, "reject:run")
            .when(x["bits"] < 1.5, "reject:entropy")
            .otherwise("pass:text")
        )
        return let(reason, lambda r: F.struct(F.startswith(r, F.lit("pass")).alias("passed"), r.alias("reason"), F.coalesce(x["run"], F.lit(0)).alias("run"), F.round(F.coalesce(x["bits"], F.lit(0.0)), 6).alias("entropy")))

    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return let(F.struct(longest_printable_run(text).alias("run"), entropy(text).alias("bits")), decided)


def decoded_layers(batches: Iterator) -> Iterator:
    """Arrow helper: (id, text) -> NFKC text and up to three layers of percent, base64 and hex decoding."""
    import base64
    import binascii
    import re
    import unicodedata
    from urllib.parse import unquote

    import pyarrow as pa

    def decoded(token: str, hexed: bool) -> str | None:
        try:
            raw = binascii.unhexlify(token) if hexed else base64.b64decode(token.rstrip("=") + "=" * (-len(token.rstrip("=")) % 4), altchars=b"-_" if re.search("[-_]", token) else None)
            found = raw.decode("utf-8")
        except (ValueError, binascii.Error):
            return None
        return found if sum(c.isprintable() for c in found) >= 0.85 * len(found) else None

    def views(text: str) -> list[str]:
        """All decodings, level by level; each different text once, so that repeats end the search."""
        out = dict.fromkeys([unicodedata.normalize("NFKC", text), text])
        edge = [text]
        for _ in range(3):
            after: list[str] = []
            for t in edge:
                if "%" in t:
                    after.append(unquote(t))
                after += [d for x in re.findall(r"[A-Za-z0-9+/_-]{24,65536}={0,2}", t) if (d := decoded(x, False)) is not None]
                after += [d for x in re.findall(r"(?:[0-9A-Fa-f]{2}){16,}", t) if (d := decoded(x, True)) is not None]
            edge = [t for t in dict.fromkeys(after) if t not in out]
            out |= dict.fromkeys(edge)
        return [t for t in out if t != text or t == next(iter(out))]

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(i, k + 2, v) for i, t in zip(ids, texts) for k, v in enumerate(views(t or ""))]
        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["id", "ord", "variant"])


def variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, variant: raw (0), stripped (1), normalised and decoded (2..), each different text once, the first kept."""
    from pyspark.sql import Window as W

    base = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    plain = base.select("id", F.posexplode(F.array("t", strip_invisible(F.col("t")))).alias("ord", "variant"))
    deep = base.mapInArrow(decoded_layers, "id long, ord int, variant string")
    once = plain.unionByName(deep).withColumn("r", F.row_number().over(W.partitionBy("id", F.xxhash64("variant"), F.length("variant")).orderBy("ord")))
    return once.where("r = 1").select(F.col("id").alias(key), "ord", "variant")


def cheapest(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, rule_id, ord: for each rule the first variant in build order that shows it."""
    passed = df.where(gate(F.col(text))["passed"])
    found = scan(variants(passed, key, text), "variant", "memo").select(key, "ord", F.explode("findings.rule_id").alias("rule_id"))
    return found.groupBy(key, "rule_id").agg(F.min("ord").alias("ord"))
