"""Reworded payloads in eight tiers, and how many of them the rules still find. Choices come from a hash of the payload's
number, the tier and the variant, so a table of mutations is the same wherever and whenever it is made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.textops import once

#: Other words for words of payloads.
SYNONYMS = {
    "copy": ["duplicate", "clone", "mirror", "replicate"], "append": ["add", "attach", "tack on"], "every": ["each", "all", "any"], "ignore": ["disregard", "skip", "set aside", "forget"],
    "previous": ["prior", "earlier", "former", "above"], "instructions": ["rules", "directions", "orders", "guidance"], "file": ["document", "page"], "send": ["transmit", "deliver", "relay", "forward"],
    "never": ["do not ever", "at no point"], "mention": ["tell", "reveal", "show"],
}
FILLERS = ["Please note: ", "By the way, ", "As part of the usual setup, ", "For order in the house, ", "Important: "]
PASSIVE = {"^please copy": "this should be copied:", "^ignore": "what should be disregarded is", "^now take": "what should be taken is"}
TIERS = {"verbatim": 1, "casing": 4, "filler": 4, "synonym": 8, "reorder": 1, "synonym+filler": 8, "passive": 1, "combined": 8}


def draw(n: int, *salt: Column) -> Column:
    return F.pmod(F.xxhash64(*salt), F.lit(n)).cast("int")


def synonyms(text: Column, *salt: Column) -> Column:
    """Three quarters of the known words of a text in other words."""
    known = F.create_map(*[x for word, others in SYNONYMS.items() for x in (F.lit(word), F.array(*[F.lit(o) for o in others]))])

    def one(word: Column, i: Column) -> Column:
        core = F.regexp_extract(word, "[A-Za-z]+", 0)
        others = F.try_element_at(known, F.lower(core))
        pick = F.get(others, F.pmod(F.xxhash64(i, *salt), F.size(others)).cast("int"))
        return F.when(others.isNotNull() & (draw(4, F.lit("s"), i, *salt) < 3), F.replace(word, core, pick)).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def casing(text: Column, *salt: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w, i: F.when(draw(10, i, *salt) < 3, F.initcap(w)).otherwise(w)), " ")


def filler(text: Column, *salt: Column) -> Column:
    return F.concat(F.get(F.array(*[F.lit(f) for f in FILLERS]), draw(len(FILLERS), F.lit("f"), *salt)), F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def reorder(text: Column) -> Column:
    parts = F.split(F.trim(text), "(?<=[.!?])\\s+")
    return F.when(F.size(parts) > 1, F.concat_ws(" ", F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))).otherwise(text)


def passive(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?i){p[0]}\\b", p[1]), PASSIVE.items(), text)


#: Number of a tier's first variant among all variants.
FIRST = {n: sum(list(TIERS.values())[:i]) for i, n in enumerate(TIERS)}


def mutations(payloads: DataFrame, key: str, text: str, carried: tuple = (), chosen: Column | None = None) -> DataFrame:
    """key, tier, variant, text and the carried columns: TIERS variants of each payload, or the one whose number (from 0,
    over all tiers) is chosen."""
    t, salt = F.col(text), [F.col(key), F.col("tier"), F.col("variant")]
    tiers = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(k).alias("variant")) for n, count in TIERS.items() for k in range(count)])
    if chosen is not None:
        tiers = F.filter(tiers, lambda m: F.try_element_at(F.create_map(*[F.lit(x) for pair in FIRST.items() for x in pair]), m["tier"]) + m["variant"] == chosen)
    rows = payloads.select(key, text, *carried, F.explode(tiers).alias("m")).select(key, text, *carried, "m.*")
    rows = once(rows, "reworded", synonyms(t, *salt))
    rows = once(rows, "mixed", filler(casing(F.col("reworded"), *salt), *salt))
    made = {"casing": casing(t, *salt), "filler": filler(t, *salt), "synonym": F.col("reworded"), "reorder": reorder(t), "synonym+filler": filler(F.col("reworded"), *salt), "passive": passive(t), "combined": reorder(F.col("mixed"))}
    return rows.select(key, "tier", "variant", *carried, reduce(lambda other, m: F.when(F.col("tier") == m[0], m[1]).otherwise(other), made.items(), t).alias("text"))


def survival(found: DataFrame) -> DataFrame:
    """tier, caught, total, rate of scanned mutations (tier, findings)."""
    hit = F.size("findings") > 0
    return found.groupBy("tier").agg(F.count_if(hit).alias("caught"), F.count("*").alias("total"), F.round(F.count_if(hit) / F.count("*"), 4).alias("rate"))
