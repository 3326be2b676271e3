"""URL filter: explicit rules, and a path-template tree for the rest.

Every url is split into host and path. Rules (host, path, verdict) fit their host and its subdomains when the path starts
with theirs; the longest fitting rule decides, and its urls are the labels of the tree.

The tree has, per host, all levels of path segments; numbers, dates, hex names and file endings after numbers are
variables from the start. Level by level a segment stays itself only if it is labelled while its siblings are not, or its
block rate differs from theirs by more than Z standard errors; all others, being variable or statistically alike, are
merged into one wildcard branch, however many or rare they are. It goes on level by level while a template with
labels holds more than one shape; what is left of such paths tells nothing apart and is wildcards. A template's purity is its block rate, smoothed by WEIGHT labels that allow; urls of templates with purity of at least
REJECT are blocked, so nothing is blocked without labels of its own template.

Null urls and urls without "://" have an empty host and path, fit no rule, and are judged by the template of the empty
host. Repeated rows are kept; without any label everything that no rule decides is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import join_checked, settle

Z, WEIGHT, REJECT = 1.96, 4.0, 0.5
#: Fixed values of the contract: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest fitting rule; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def typed_segments(path: Column) -> Column:
    """Path segments with self-evident variables replaced by their kind."""
    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), F.lit("{date}"))
            .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.([A-Za-z0-9]+)$", 1)))
            .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def templates(shapes: DataFrame) -> DataFrame:
    """Template of each (host, segs), given its counts n, blocked, allowed."""
    now = settle(shapes.withColumn("template", F.lit("")), "shapes")
    level = 0
    while True:
        alike = now.groupBy("host", "template").agg(F.max(F.size("segs")).alias("deep"), F.count("*").alias("shapes"), F.sum(F.col("blocked") + F.col("allowed")).alias("labels"))
        if alike.where((F.col("deep") > level) & (F.col("shapes") > 1) & (F.col("labels") > 0)).isEmpty():
            break
        seg = F.get("segs", F.lit(level))
        node = now.where(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
        node = settle(node, "nodes")
        about = node.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_b"), F.sum(F.col("blocked") + F.col("allowed")).alias("all_l"))
        both = join_checked(node, about, ["host", "template"])
        labelled = F.col("blocked") + F.col("allowed")
        others = F.col("all_l") - labelled
        rest_rate = (F.col("all_b") - F.col("blocked") + 1) / (others + 2)
        own_rate = (F.col("blocked") + 1) / (labelled + 2)
        error = F.sqrt(rest_rate * (1 - rest_rate) / (others + 2) + own_rate * (1 - own_rate) / (labelled + 2))
        differs = (labelled > 0) & ((others == 0) | (F.abs(own_rate - rest_rate) > Z * error))
        literal = settle(both.where(differs).select("host", "template", "seg", F.lit(True).alias("literal")), "literals")
        next_ = join_checked(now.withColumn("seg", seg), literal, ["host", "template", "seg"])
        shape = F.when(F.col("seg").isNull(), F.lit("")).when(F.col("literal"), F.concat(F.lit("/"), F.col("seg"))).otherwise(F.lit("/*"))
        now = settle(next_.withColumn("template", F.concat("template", shape)).select("host", "segs", "n", "blocked", "allowed", "template"), "shapes")
        level += 1
    return now.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("segs") - level, F.lit(0)))))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages."""
    host, path = split_url(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "ruled": verdict, "segs": typed_segments(F.col("path"))})
    shapes = parsed.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count_if(F.col("ruled") == "allow").alias("allowed"))
    shaped = templates(shapes)
    pure = shaped.groupBy("host", "template").agg((F.sum("blocked") / (F.sum(F.col("blocked") + F.col("allowed")) + WEIGHT)).alias("purity"))
    judged = settle(join_checked(shaped.select("host", "segs", "template"), pure, ["host", "template"]), "judged")
    out = join_checked(parsed, judged, ["host", "segs"])
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
