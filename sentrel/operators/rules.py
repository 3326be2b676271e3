"""The content rules as one column transform: text -> status and findings, at most one finding per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel import lexicon as L
from sentrel.functions.textops import REACH, excerpt, line_of, once, signs_of, window, with_firsts, with_signs


def descriptive(text: str | Column, start: Column) -> Column:
    """Whether what surrounds a start describes an attack: commands never do; attributions and prohibitions do; a topic
    does inside document structure."""
    near = window(text, start, start, REACH)
    return ~near.rlike(L.quick(L.IMPERATIVE)) & (near.rlike(L.quick(L.ATTRIBUTED)) | near.rlike(L.quick(L.PROHIBITED)) | (near.rlike(L.quick(L.TOPIC)) & near.rlike(L.STRUCTURE)))


def comments(text: Column) -> Column:
    """Bodies of HTML comments of at most 8,000 and at least 12 characters; linear in the text."""
    parts = F.slice(F.split(text, "<!--", -1), 2, 1 << 30)
    bodies = F.transform(F.filter(parts, lambda b: F.instr(b, "-->") > 0), lambda b: F.substring_index(b, "-->", 1))
    return F.filter(bodies, lambda b: (F.length(b) <= 8000) & (F.length(F.trim(b)) >= 12))


def hostile_comment(body: Column) -> Column:
    return body.rlike(L.quick(L.OVERRIDE)) | body.rlike(L.quick(L.CONCEAL)) | (body.rlike(L.quick(L.SELF_REFERENCE)) & body.rlike(L.quick(L.COPY_VERB)))


def scan(df: DataFrame, text: str, channel: str = "scan", rules: list[str] | None = None) -> DataFrame:
    """Adds status ('ok' or 'truncated'; 'missing' for null), findings and suppressed.

    A finding is (rule_id, severity, at, line, excerpt). Rules that a line scan-allow names on the same or the line before
    go to suppressed. Null texts have no findings but the status says so. With rules only these are looked for; rules do
    not depend on each other."""
    cap, kept = L.CHANNELS[channel]
    kept = [r for r in kept if rules is None or r in rules]
    t = "__t"
    whole = F.coalesce(F.col(text), F.lit(""))
    # no text of so few bytes has more characters
    df = df.withColumn("__cut", F.when(F.octet_length(whole) <= cap, whole).otherwise(F.substring(whole, 1, cap))).withColumn(t, F.lower("__cut"))
    ranged = lambda h, reach: window(h["near"], h["at"], h["at"] + h["e"] - h["p"], reach)
    described = lambda h: descriptive(h["near"], h["at"])
    firsts = {
        "__selfref": (L.SELF_REFERENCE, lambda h: ranged(h, 160).rlike(L.quick(L.COPY_VERB)) & ranged(h, 300).rlike(L.quick(L.COPY_TARGET)) & ~described(h)),
        "__override": (L.OVERRIDE, lambda h: ~described(h)),
        "__secret": (L.SECRET, lambda h: ranged(h, 200).rlike(L.quick(L.SEND_VERB)) & ranged(h, 300).rlike(L.DESTINATION) & ~(ranged(h, 300).rlike(L.PLACEHOLDER) & described(h))),
        "__conceal": (L.CONCEAL, lambda h: (ranged(h, 250).rlike(L.quick(L.SEND_VERB)) | ranged(h, 250).rlike(L.quick(L.SECRET)) | ranged(h, 250).rlike(L.quick(L.COPY_VERB))) & ~described(h)),
        "__role": (L.ROLE, lambda h: F.lit(True)),
    }
    of = {"INJ-001": "__selfref", "INJ-002": "__override", "INJ-003": "__secret", "INJ-007": "__conceal", "INJ-008": "__role"}
    firsts = {of[r]: firsts[of[r]] for r in of if r in kept}
    marks = {"INJ-004": "<!--", "INJ-005": L.ZERO_WIDTH, "INJ-006": L.TAG_BLOCK}
    df, place_of = with_signs(df, t, "__signs", [*map(L.sign, [p for p, _ in firsts.values()]), *[p for r, p in marks.items() if r in kept], L.ALLOW])
    has = lambda pattern: place_of(pattern) != -1
    df = with_firsts(df, t, firsts, signs_of(firsts, place_of)) if firsts else df
    place = {
        "INJ-004": F.when(F.exists(comments(F.col(t)), hostile_comment), F.instr(t, "<!--") - 1),
        "INJ-005": F.length(F.get(F.split(t, L.ZERO_WIDTH, 2), F.lit(0))), "INJ-006": F.length(F.get(F.split(t, L.TAG_BLOCK, 2), F.lit(0))),
    }
    at = {r: F.col(n) for r, n in of.items() if n in firsts} | {r: F.when(has(p), place[r]) for r, p in marks.items() if r in kept}
    if "INJ-008" in at:
        at["INJ-008"] = F.when(~descriptive(t, at["INJ-008"]), at["INJ-008"])
    # places first and findings once, as conditions on them would compute them again
    df = once(df, "__at", F.struct(*[at[r].alias(r) for r in kept]))
    placed = {r: F.col("__at")[r] for r in kept}
    made = [F.when(placed[r].isNotNull(), F.struct(F.lit(r).alias("rule_id"), F.lit(L.RULES[r][1]).alias("severity"), placed[r].alias("at"))) for r in kept]
    df = once(df, "__f", F.filter(F.array(*made), lambda f: f.isNotNull()))
    # a match may begin with the line break before its first word
    word = lambda at: at + F.when(F.substring(F.col("__cut"), at + 1, F.lit(1)) == "\n", 1).otherwise(0)
    full = lambda f: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity"), f["at"].alias("at"), line_of(F.col("__cut"), word(f["at"])).alias("line"), excerpt(F.col("__cut"), f["at"]).alias("excerpt"))
    lines = F.split(F.col(t), "\n")

    def allowed(f: Column) -> Column:
        n = line_of(F.col("__cut"), f["at"] + 1)
        near = F.concat_ws(" ", F.get(lines, n - 1), F.get(lines, n - 2), F.get(lines, n))
        named = F.contains(F.regexp_extract(near, L.SUPPRESS, 0), F.lower(f["rule_id"]))
        return F.when(has(L.ALLOW), F.coalesce(named, F.lit(False))).otherwise(False)

    status = F.when(F.col(text).isNull(), "missing").when(F.length(text) > cap, "truncated").otherwise("ok")
    df = once(df.withColumn("status", status).drop("findings"), "findings", F.transform(F.filter("__f", lambda f: ~allowed(f)), full))
    out = df.withColumn("suppressed", F.transform(F.filter("__f", allowed), lambda f: f["rule_id"]))
    return out.drop("__cut", t, "__signs", "__at", "__f", *firsts)


def findings(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row per finding."""
    return scanned.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")
