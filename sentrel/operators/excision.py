"""Cutting findings out of texts until a rescan with all rules finds nothing more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.textops import once
from sentrel.operators.rules import scan
from sentrel.sources.work import settled

PASSES = 5


def _after(text: Column, mark: str) -> Column:
    """Start of the last mark, or -1."""
    return F.when(F.contains(text, F.lit(mark)), F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)).otherwise(-1)


def cut(df: DataFrame, text: str) -> DataFrame:
    """Adds excised and removed (the regions cut out) for a scanned text with findings.

    The region of a finding is the whole comment that its line lies in, however many lines that has, else the paragraph
    around the line; blank lines and headings bound paragraphs. Gaps of blank lines that cutting leaves close up."""
    lines = F.split(F.col(text), "\n")
    df = once(df, "__lines", lines)
    place = lambda x, i: F.struct(
        i.alias("i"), ((F.trim(x) == "") | F.startswith(F.ltrim(x), F.lit("#"))).alias("edge"), F.contains(x, F.lit("<!--")).alias("opens"), F.contains(x, F.lit("-->")).alias("closes"),
        (F.contains(x, F.lit("-->")) & (~F.contains(x, F.lit("<!--")) | (F.instr(x, "-->") < F.instr(x, "<!--")))).alias("starts_closed"), (_after(x, "<!--") > _after(x, "-->")).alias("ends_open"),
    )
    df = once(df, "__marks", F.filter(F.transform("__lines", place), lambda m: m["edge"] | m["opens"] | m["closes"]))
    last = F.size("__lines") - 1

    def region(f: Column) -> Column:
        at = f["line"].cast("int") - 1
        pick = lambda test: F.transform(F.filter("__marks", test), lambda m: m["i"])
        tagged = lambda m: m["opens"] | m["closes"]
        above = F.try_element_at(F.filter("__marks", lambda m: tagged(m) & (m["i"] <= at)), F.lit(-1))["ends_open"]
        below = F.get(F.filter("__marks", lambda m: tagged(m) & (m["i"] >= at)), F.lit(0))["starts_closed"]
        inside = F.coalesce(above, F.lit(False)) | F.coalesce(below, F.lit(False))
        begin = F.when(inside, F.coalesce(F.array_max(pick(lambda m: m["opens"] & (m["i"] <= at))), F.lit(0))).otherwise(F.coalesce(F.array_max(pick(lambda m: m["edge"] & (m["i"] < at))) + 1, F.lit(0)))
        end = F.when(inside, F.coalesce(F.array_min(pick(lambda m: m["closes"] & (m["i"] >= at))), last)).otherwise(F.coalesce(F.array_min(pick(lambda m: m["edge"] & (m["i"] > at))) - 1, last))
        return F.struct(begin.alias("a"), end.alias("b"))

    df = once(df.withColumn("__had", F.size("findings") > 0), "__regions", F.array_sort(F.array_distinct(F.transform("findings", region))))
    kept = F.array_join(F.filter("__lines", lambda x, i: ~F.exists("__regions", lambda r: (i >= r["a"]) & (i <= r["b"]))), "\n")
    removed = F.transform("__regions", lambda r: F.array_join(F.slice("__lines", r["a"] + 1, r["b"] - r["a"] + 1), "\n"))
    out = df.withColumns({"excised": F.when(F.col("__had"), F.regexp_replace(kept, "\n{3,}", "\n\n")).otherwise(F.col(text)), "removed": removed})
    return out.drop("__lines", "__marks", "__regions", "__had")


def excise_until_clean(texts: DataFrame, keys: list[str], text: str, channel: str = "scan", passes: int = PASSES) -> DataFrame:
    """keys, body (null as empty), excised, removed, passes, clean and the findings of the first scan, for each row.

    Each pass scans only what the last one changed: rows without findings are done, and so are rows that cutting leaves as
    they are, which are not clean. A row that still has findings after the last pass is not clean either. Empty texts are
    clean at once; equal rows are treated alike, each on its own."""
    none = F.array().cast("array<string>")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    todo = texts.select(*keys, body.alias("body"), body.alias("__now"), none.alias("__removed"), F.lit(0).alias("passes"))
    done = []
    for turn in range(passes + 1):
        scanned = scan(todo, "__now", channel).drop("suppressed", "status")
        if turn == 0:
            scanned = scanned.withColumn("__first", F.col("findings"))
        part = settled(cut(scanned, "__now"), "excised")
        found = F.size("findings") > 0
        stuck = found & ((F.col("excised") == F.col("__now")) | F.lit(turn == passes))
        over = part.where(~found | stuck)
        done.append(over.select(*keys, "body", F.col("__now").alias("excised"), F.col("__removed").alias("removed"), "passes", F.col("__first").alias("findings"), (~found).alias("clean")))
        todo = part.where(found & ~stuck).select(*keys, "body", F.col("excised").alias("__now"), F.concat("__removed", "removed").alias("__removed"), (F.col("passes") + 1).alias("passes"), "__first")
        if turn == passes or todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
