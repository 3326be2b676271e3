"""Column builders over text: match positions, windows, lines, excerpts, entropy, printable runs, keyed hashes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel import lexicon as L

#: Characters of a block, and those around a match that its tests may look at.
BLOCK, REACH = 1024, 320
#: Different characters that entropy() counts one by one.
SIGNS = 256
#: Characters of the longest term of a bounded pattern, and matches of a text from which on it is cut into blocks.
TERM, FEW = 128, 4


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that lambdas may refer to without computing it for each element: a one-row generator keeps the
    optimizer from merging the projections."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_firsts(df: DataFrame, text: str, wanted: dict[str, tuple[str, Callable[[Column], Column]]], signs: dict[str, Column] | None = None) -> DataFrame:
    """For each name with (pattern, test) the start of the first match that passes the test, in code points from 0.

    All matches are looked at, in one pass: a start is the end of the match before it and the length of what a split leaves
    between. A test gets (p, e, at, near): start, end, and the start within near, the text up to REACH characters around
    the match; where there are many matches, near comes from blocks, so one deep in a text costs no more than one at its
    start. Bounded patterns are searched in their quick form; the character before a match still counts as its first one.
    signs are places of what all matches of a name's pattern hold at their start (see with_signs): a text without one is
    not searched, one with a single sign only where it stands."""
    signs, quick, lead = signs or {}, {n: L.quick(r) for n, (r, _) in wanted.items()}, {n: int(L.quick(r) != r) for n, (r, _) in wanted.items()}
    none = F.array().cast("array<string>")
    begin = {n: F.when(c > 0, c - 1).otherwise(0) if (c := signs.get(n)) is not None else F.lit(0) for n in wanted}
    searched = {n: F.when(c >= 0, F.substring(F.col(text), begin[n] + 1, F.lit(TERM + 2))).otherwise(F.col(text)) if (c := signs.get(n)) is not None else F.col(text) for n in wanted}

    def all_of(n: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(f"__in.{n}"), F.lit(pattern), F.lit(0))
        return F.when(F.col(f"__in.{n}").isNotNull(), found).otherwise(none)

    df = once(df, "__in", F.struct(*[(F.when(signs[n] != -1, x) if n in signs else x).alias(n) for n, x in searched.items()]))
    df = once(df, "__m", F.struct(*[all_of(n, r).alias(n) for n, r in quick.items()]))
    many = F.greatest(*[F.size(f"__m.{n}") for n in wanted], F.lit(0)) > FEW
    between = [F.when(F.size(f"__m.{n}") > 0, F.split(F.col(f"__in.{n}"), r, -1)).alias(n) for n, r in quick.items()]
    df = once(df, "__s", F.struct(*between, F.when(many, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("__blocks")))

    def first(n: str, test: Callable[[Column], Column]) -> Column:
        def step(a: Column, x: Column) -> Column:
            word = a["e"] + F.length(F.get(F.col(f"__s.{n}"), a["i"]))
            p = F.greatest(word - lead[n], F.lit(0))
            spot = F.struct(p.alias("p"), (word + F.length(x)).alias("e"), F.greatest(p - REACH, F.lit(0)).alias("left"))
            let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

            def near(h: Column) -> Column:
                k, size = F.floor(h["left"] / BLOCK).cast("int"), h["e"] + REACH - h["left"]
                blocks = F.slice("__s.__blocks", k + 1, F.floor(size / BLOCK).cast("int") + 2)
                there = F.when(F.col("__s.__blocks").isNull(), F.substring(F.col(text), h["left"] + 1, size)).otherwise(F.substring(F.array_join(blocks, ""), h["left"] - k * BLOCK + 1, size))
                return F.struct(h["p"].alias("p"), h["e"].alias("e"), (h["p"] - h["left"]).alias("at"), there.alias("near"))

            found = lambda h: let(near(h), lambda y: F.when(test(y), y["p"]))
            return let(spot, lambda h: F.struct((a["i"] + 1).alias("i"), h["e"].alias("e"), F.coalesce(a["first"], found(h)).alias("first")))

        start = F.struct(F.lit(0).alias("i"), begin[n].alias("e"), F.lit(None).cast("int").alias("first"))
        return F.when(F.size(f"__m.{n}") > 0, F.aggregate(f"__m.{n}", start, step, lambda a: a["first"]))

    df = once(df, "__firsts", F.struct(*[first(n, test).alias(n) for n, (_, test) in wanted.items()]))
    return df.select("*", *[F.col(f"__firsts.{n}").alias(n) for n in wanted]).drop("__in", "__m", "__s", "__firsts")


def with_signs(df: DataFrame, text: str, name: str, patterns: list[str]) -> tuple[DataFrame, Callable[[str], Column]]:
    """Adds an array of places of patterns in a text, and gives the column of a pattern's place: the character from 0 where
    its only match starts, -1 if there is none, -2 if there are more.

    Most texts hold none of what the rules look for, so this look comes before their searches: one UDF over Arrow batches,
    a pass a pattern that takes no longer for many terms than for one. Patterns are read by RE2; null texts hold nothing.
    Texts must be valid UTF-8, as lower() leaves them."""
    looked = list(dict.fromkeys(patterns))

    @F.arrow_udf("array<int>")
    def places(texts: pa.Array) -> pa.Array:
        out = np.full((len(texts), len(looked)), -1, np.int32)
        for i, pattern in enumerate(looked):
            n = pc.count_substring_regex(texts, pattern).fill_null(0).to_numpy(zero_copy_only=False)
            out[n > 1, i] = -2
            (single,) = np.nonzero(n == 1)
            if len(single):
                before = pc.list_element(pc.split_pattern_regex(texts.take(pa.array(single)), pattern, max_splits=1), 0)
                out[single, i] = pc.utf8_length(before).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(looked), np.int32)), pa.array(out.ravel()))

    return df.withColumn(name, places(text)), lambda pattern: F.get(F.col(name), F.lit(looked.index(pattern)))


def signs_of(wanted: dict[str, tuple], place: Callable[[str], Column]) -> dict[str, Column]:
    """The signs of patterns for with_firsts. Only matches of bounded patterns start with theirs; before that of another more
    may stand, so its texts are searched as a whole."""
    whole = lambda c: F.when(c == -1, -1).otherwise(-2)
    return {n: place(L.sign(r)) if L.quick(r) != r else whole(place(L.sign(r))) for n, (r, _) in wanted.items()}


def window(text: str | Column, start: Column, end: Column, reach: int) -> Column:
    """Characters from start - reach up to end + reach."""
    text = F.col(text) if isinstance(text, str) else text
    left = F.greatest(start - reach, F.lit(0))
    return F.substring(text, left + 1, end + reach - left)


def line_of(text: Column, start: Column) -> Column:
    head = F.substring(text, F.lit(1), start)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def excerpt(text: Column, start: Column) -> Column:
    """36 characters before a start to 110 after it on one line; dots where the text goes on."""
    left = F.greatest(start - 36, F.lit(0))
    inner = F.trim(F.regexp_replace(F.substring(text, left + 1, start + 110 - left), "\\s+", " "))
    return F.concat(F.when(left > 0, "...").otherwise(""), inner, F.when(start + 110 < F.length(text), "...").otherwise(""))


def entropy(text: Column) -> Column:
    """Shannon bits per character; empty is 0. Characters are taken out of the text one after the other, the first SIGNS of
    them at most; what is left then, of texts with more different ones, is sorted, so that equal ones are runs."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def out(a: Column, _: Column) -> Column:
        first = F.substring(a["rest"], 1, 1)
        share = lambda x: (F.octet_length(a["rest"]) - F.octet_length(x["left"])) / F.octet_length(x["first"]) / a["n"]
        fewer = lambda x: let(share(x), lambda p: F.struct(x["left"].alias("rest"), (a["bits"] - p * F.log2(p)).alias("bits"), a["n"].alias("n")))
        return F.when(a["rest"] == "", a).otherwise(let(F.struct(F.replace(a["rest"], first, F.lit("")).alias("left"), first.alias("first")), fewer))

    def others(a: Column) -> Column:
        runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(a["rest"], "")), ""), F.lit("(?s)(.)\\1*+"), F.lit(0))
        shares = F.transform(runs, lambda r: F.length(r) / a["n"])
        return F.when(a["rest"] == "", a["bits"]).otherwise(F.aggregate(shares, a["bits"], lambda s, p: s - p * F.log2(p)))

    start = lambda t: F.struct(t.alias("rest"), F.lit(0.0).alias("bits"), F.length(t).alias("n"))
    bits = lambda t: F.when(t != "", F.aggregate(F.sequence(F.lit(1), F.lit(SIGNS)), start(t), out, others)).otherwise(F.lit(0.0))
    return let(text, bits)


def longest_printable_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("[\\x20-\\x7E\\x{A0}-\\x{FFFC}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def inserted(text: Column, at: int, piece: Column) -> Column:
    """A text with a piece behind its first characters. What follows is taken by bytes, so that the whole text is not walked
    through character by character; a character has four bytes at most."""
    raw = text.cast("binary")
    head = F.substring(F.substring(raw, 1, 4 * at).cast("string"), 1, at)
    return F.concat(head.cast("binary"), piece.cast("binary"), F.substring(raw, F.octet_length(head) + 1, F.octet_length(text))).cast("string")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{E0000}-\\x{E007F}]", "")


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Keyed hash from two plain ones; keys longer than a block are not used."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the salt has 16 to 64 bytes")
    pad = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in pad)), text.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in pad)), F.unhex(inner)), 256)


def amount_band(amount: Column) -> Column:
    """Six half-open bands of a whole count; null if it is none."""
    a = amount
    return F.when(a.isNull() | (a < 0) | (a != F.floor(a)), F.lit(None)).when(a < 10, "<10").when(a < 100, "10-99").when(a < 1000, "100-999").when(a < 10_000, "1k-9k").when(a < 100_000, "10k-99k").otherwise("100k+")
