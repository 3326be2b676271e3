"""Personal data: exact base patterns, and boosted trees over further candidates. DataFrame functions and Spark ML only.

Base spans are the leftmost non-overlapping matches of four patterns, of which those failing a check (octets, Luhn, digit
counts) are dropped. High-recall generators propose more, whose spans may overlap: addresses written out or spaced, masked
or spaced network addresses and those of version 6, cards and phones with other separators, two groups or none, and
secrets (long mixed tokens, values set behind a telling word). Gradient-boosted trees, trained here on EXAMPLES generated
from RECIPES in and out of telling contexts, score them from their format (groups, separators, checks, letters) and
context (words and characters around); those above their kind's threshold, calibrated for PRECISION on held-out examples,
are redactions. Base spans always stay; a candidate that touches one goes, and of candidates that overlap the better stays.

Positions are code points. They come from the lengths of what a split leaves between matches, summed by a window over a
row's matches, so a text with very many matches costs in proportion. Null is the empty text; repeated rows are kept.
Secrets are no kind of the contract's spans and have columns of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrel.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
#: Fixed values of the contract, with possessive runs that match the same, never search a run twice and need no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r" ?(?:@|[(\[{] ?at ?[)\]}]) ?", r" ?(?:\.|[(\[{] ?(?:dot|\.) ?[)\]}]) ?"
_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey")
_TOLD = f"(?i:{'|'.join(_WORDS)})"
#: Generators of further candidates: kind, name, pattern.
WIDE = [
    ("email", "written", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,24}}){{1,5}}+"),
    ("ip", "masked", rf"(?=[0-9])(?<![0-9A-Za-z.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9A-Za-z])"),
    ("ip", "six", r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}+:){7}[0-9a-f]{1,4}+(?![0-9a-z:])|(?<![0-9a-z:])(?:[0-9a-f]{1,4}+:){1,6}:(?:[0-9a-f]{1,4}+:){0,5}[0-9a-f]{1,4}+(?![0-9a-z:])"),
    ("card", "grouped", r"(?=[0-9])(?<![0-9A-Za-z])[0-9]{4}[./_ -]{1,2}(?:[0-9]{4}[./_ -]{1,2}[0-9]{4}[./_ -]{1,2}[0-9]{1,7}|[0-9]{6}[./_ -]{1,2}[0-9]{5})(?![0-9A-Za-z])"),
    ("phone", "groups", r"(?=[(0-9])(?<![0-9A-Za-z+])[(]?[0-9]{2,5}+[)]?(?:[ ./-]{1,2}[0-9]{2,8}+){1,5}(?![0-9A-Za-z])"),
    ("phone", "bare", r"(?=[0-9])(?<![0-9A-Za-z+.,])[0-9]{7,13}+(?![0-9A-Za-z])"),
    ("secret", "mixed", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]{0,40}[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}"),
    ("secret", "told", rf"(?<=[=: \"'])(?<={_TOLD}[\"']? ?[:=] ?[\"']?)[^\x20\t\r\n\"'<>,;=]{{6,64}}+"),
]
EXAMPLES, PRECISION, BEFORE, AFTER = 8000, 0.995, 24, 12
#: Words of a context that speak for a kind, and those that speak against numbers being anyone's.
CUES = {
    "email": r"(?i)(mail|contact|write|reach|courriel|correo|kontakt)", "ip": r"(?i)(\bip\b|address|host|server|login|from|adresse|addr|peer|client)",
    "card": r"(?i)(card|visa|carte|karte|tarjeta|credit|master)", "phone": r"(?i)(phone|call|tel|mobile|cell|fax|telefon|whatsapp|sms|ring|appel|llama|anruf|mobil)",
    "secret": r"(?i)(token|secret|key|passw|pwd|bearer|credential|auth)",
}
AGAINST = r"(?i)(version|release|page|seite|order|invoice|isbn|part|serial|section|chapter|price|total|sum|id|no\.|\$|€|year|between|from|figure|table|sha|commit|hash|path|file)[^A-Za-z0-9]{0,4}$"
#: Format and context, as the trees see them.
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "is_secret", "digits", "groups", "longest", "dots", "dashes", "spaces", "slashes", "parens", "ats", "colons", "luhn", "octets", "upper", "lower", "kinds", "variety", "cue", "against", "touches", "after", "year", "length")
#: Training recipes: kind, label, shape, context (c telling, n plain, a against, any letters of these). In a shape # is a
#: digit, % one from 1 to 9, & a letter, ^ a hex digit, ~ a letter or digit of either case, $ the digit that makes the
#: check sum right, ! one that does not; all else stands for itself.
RECIPES = [
    ("email", 1, "&&&&.##(at)&&&&&(dot)com", "cn"), ("email", 1, "&&&&& [at] &&&& [dot] org", "cn"), ("email", 1, "&&&(at)&&&&(dot)co(dot)uk", "cn"), ("email", 1, "&(at)&&&&&&.net", "cn"),
    ("email", 1, "&&&&&&{at}&&&{dot}&&&{dot}de", "cn"), ("email", 1, "&&&&_&&& @ &&&&&.com", "c"), ("email", 0, "&&&& @ &&&& . &&&&", "na"), ("email", 0, "## @ &&&&. &&&", "na"), ("email", 0, "&& @ &&&& . &&", "a"),
    ("ip", 1, "1##[.]##[.]1##[.]%#", "cn"), ("ip", 1, "%#(dot)1##(dot)%(dot)1##", "cn"), ("ip", 1, "1## . %# . %# . 1##", "c"), ("ip", 1, "^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^", "cn"), ("ip", 1, "fe80::^^^^:^^^^:^^^^:^^^^", "cn"), ("ip", 1, "2001:db8:^^^^::%", "cn"),
    ("ip", 0, "9%#[.]8##[.]7##[.]9##", "cn"), ("ip", 0, "%# . %# . %# . %#", "na"), ("ip", 0, "%. %. %. %", "na"), ("ip", 0, "1#:5#::%", "na"),
    ("card", 1, "4###.####.####.###$", "cn"), ("card", 1, "5%##/####/####/###$", "cn"), ("card", 1, "4###  ####  ####  ###$", "cn"), ("card", 1, "4###_####_####_###$", "cn"), ("card", 1, "37##.######.####$", "cn"),
    ("card", 0, "4###.####.####.###!", "na"), ("card", 0, "####/####/####/###!", "na"), ("card", 0, "20##.20##.20##.%%%", "na"), ("card", 0, "####_####_####_###!", "cna"),
    ("phone", 1, "(###) ###-####", "cn"), ("phone", 1, "###-###-####", "cn"), ("phone", 1, "### ### ####", "c"), ("phone", 1, "###.###.####", "c"), ("phone", 1, "0# ## ## ## ##", "cn"), ("phone", 1, "0## #######", "c"), ("phone", 1, "### ####", "c"),
    ("phone", 1, "0### / ######", "c"), ("phone", 1, "##########", "c"), ("phone", 1, "0#########", "c"), ("phone", 1, "#######", "c"), ("phone", 1, "0##-####-####", "cn"),
    ("phone", 0, "20##-0%-1#", "cna"), ("phone", 0, "1#.0%.20##", "cna"), ("phone", 0, "19##-20##", "cna"), ("phone", 0, "##########", "na"), ("phone", 0, "#######", "na"), ("phone", 0, "### ###", "na"), ("phone", 0, "### ### ###", "na"),
    ("phone", 0, "##.##", "na"), ("phone", 0, "##/##", "cna"), ("phone", 0, "### ####", "na"), ("phone", 0, "## ## ##", "na"), ("phone", 0, "###.###.###", "na"), ("phone", 0, "## ##", "cna"), ("phone", 0, "##########", "a"), ("phone", 0, "#############", "na"), ("phone", 0, "%#.## ### ##", "na"),
    ("secret", 1, "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "c"), ("secret", 1, "AKIA~~~~~~~~~~~~~~~~", "cn"), ("secret", 1, "ghp_~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "cn"), ("secret", 1, "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "c"), ("secret", 1, "sk-~~~~~~~~~~~~~~~~~~~~~~~~", "cn"), ("secret", 1, "&&&&##~~", "c"), ("secret", 1, "&&&&&&~~", "c"),
    ("secret", 0, "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "na"), ("secret", 0, "&&&&&&&&&-&&&&&&&&&-&&&&&&-20##", "na"), ("secret", 0, "/&&&&/&&&&&/&&&&&&/&&&##", "na"), ("secret", 0, "####################", "na"), ("secret", 0, "&&&&&&_&&&&&&&&_&&&&&&_##", "na"),
]
TELLING = {
    "email": ["mail ", "contact: ", "write to ", "e-mail: ", "correo "], "ip": ["host ", "from server ", "ip: ", "login from ", "address "], "card": ["card ", "visa ", "credit card number ", "Karte: ", "tarjeta "],
    "phone": ["call me at ", "phone: ", "tel. ", "my mobile is ", "tel ", "Telefon ", "fax: ", "cell "], "secret": ['token = "', "api_key=", "password: ", "secret ", "Bearer "],
}
PLAIN = ["the values were ", "of the thing ", "and then ", "", "in all ", "so that ", "la que ", "und die "]
COUNTER = ["in version ", "see page ", "order ", "serial no. ", "ISBN ", "price $", "commit ", "in the file ", "between ", "part "]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string holds; only strings of at most 19 digits are looked at."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.coalesce(F.aggregate(F.filter(places, lambda p: p.isNotNull()), F.lit(0), lambda s, p: s + p) % 10 == 0, F.lit(False))


def octets(match: Column) -> Column:
    return F.forall(F.filter(F.split(match, "[^0-9]+"), lambda p: p != ""), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) < F.when(F.regexp_replace(p, "^0+(?=[0-9])", "") <= "255", 4).otherwise(3))


def passes(kind: Column, match: Column) -> Column:
    digits = digits_of(match)
    n = F.length(digits)
    octets = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    good_ip = F.forall(octets, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    good_card = (n >= 12) & (n <= 19) & luhn(F.when((n >= 12) & (n <= 19), digits))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", good_ip).when(kind == "card", good_card).otherwise((n >= 9) & (n <= 15))


def matches(text: Column, found: Column, kind: str, source: str, pattern: str) -> Column:
    """Array of (kind, source, i, gap, match, before, after) of the matches found of one pattern."""
    gaps = F.split(text, pattern, -1)
    left = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.substring(g, -BEFORE, BEFORE).alias("before")))
    right = F.transform(F.slice(gaps, 2, 1 << 30), lambda g: F.substring(g, 1, AFTER))
    rows = F.arrays_zip(found.alias("match"), F.slice(left, 1, F.size(found)).alias("left"), right.alias("after"))
    made = F.transform(rows, lambda r, i: F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), i.alias("i"), r["left"]["gap"].alias("gap"), r["match"].alias("match"), r["left"]["before"].alias("before"), r["after"].alias("after")))
    return F.when(F.size(found) > 0, made)


def proposals(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rowno and doc_id of all rows; rowno, kind, source, start, end, match, before, after of all matches.

    A pattern is run only over texts that pass a cheap test, and texts are split only by patterns that have matches."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rowno"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])
    digit, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    worth = {
        "email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")), "written": at | text.rlike(r"[(\[{] ?at ?[)\]}]"), "masked": digit, "six": digit & F.contains(text, F.lit(":")),
        "grouped": digit, "groups": digit, "bare": digit, "mixed": digit, "told": has(*_WORDS),
    }
    patterns = [(k, k, "base", BASE[k]) for k in KINDS] + [(name, k, name, p) for k, name, p in WIDE]
    found = F.struct(*[F.when(worth[n], F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(n) for n, _, _, p in patterns])
    # a one-row generator keeps the optimizer from running a pattern for each use of its matches
    seen = source.select("*", F.explode(F.array(found)).alias("m"))
    arrays = F.array(*[matches(text, F.col(f"m.{n}"), k, where, p) for n, k, where, p in patterns])
    rows = settle(seen.select("doc_id", "rowno", F.flatten(F.filter(arrays, lambda a: a.isNotNull())).alias("found")), "found")
    flat = rows.where(F.size("found") > 0).select("rowno", F.explode("found").alias("f")).select("rowno", "f.*")
    so_far = W.partitionBy("rowno", "source", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.length("match")).over(so_far)
    spans = flat.withColumn("end", ends).withColumn("start", F.col("end") - F.length("match"))
    return rows.select("rowno", "doc_id"), spans.select("rowno", "kind", "source", "start", "end", "match", "before", "after")


def with_features(spans: DataFrame) -> DataFrame:
    m, digits = F.col("match"), digits_of(F.col("match"))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    count = lambda p: F.regexp_count(m, F.lit(p))
    cue = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("before").rlike(p) for k, p in CUES.items()])
    n = F.length(digits)
    kinds = {f"is_{k}": F.col("kind") == k for k in EVERY}
    values = kinds | {
        "digits": n, "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "dots": count(r"\."), "dashes": count("-"), "spaces": count(" "), "slashes": count("[/_]"),
        "parens": count(r"[()\[\]{}]"), "ats": count("@|at"), "colons": count(":"), "luhn": F.when((n >= 12) & (n <= 19), luhn(F.when(n <= 19, digits))).otherwise(F.lit(False)),
        "octets": F.when(F.col("kind") == "ip", octets(m)).otherwise(F.lit(False)), "upper": count("[A-Z]"), "lower": count("[a-z]"),
        "kinds": m.rlike("[A-Z]").cast("int") + m.rlike("[a-z]").cast("int") + m.rlike("[0-9]").cast("int"),
        "variety": F.size(F.array_distinct(F.split(F.substring(m, 1, 64), ""))) / F.least(F.length(m) + 1, F.lit(65)), "cue": cue, "against": F.col("before").rlike(AGAINST) & ~cue,
        "touches": F.col("before").rlike(r"[0-9A-Za-z.,/:=#-]$"), "after": F.col("after").rlike(r"^[0-9A-Za-z/:=%-]"), "year": m.rlike(r"(?<![0-9])(19|20)[0-9]{2}(?![0-9])"), "length": F.length(m),
    }
    return spans.withColumns({f: F.coalesce(values[f].cast("double"), F.lit(0.0)) for f in FEATURES})


def examples(spark: SparkSession) -> DataFrame:
    """EXAMPLES generated candidates: kind, match, before, after, label, from RECIPES."""
    draw = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda options, salt: F.get(F.array(*[F.lit(o) for o in options]), draw(len(options), salt))
    recipe = F.get(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(y)).alias("label"), F.lit(shape).alias("shape"), F.lit(where).alias("where")) for k, y, shape, where in RECIPES]), draw(len(RECIPES), 1))
    rows = spark.range(EXAMPLES).withColumn("r", recipe).select("id", "r.*")
    signs = {"#": "0123456789", "%": "123456789", "&": "abcdefghijklmnopqrstuvwxyz", "^": "0123456789abcdef", "~": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}

    def made(c: Column, i: Column) -> Column:
        out = c
        for sign, letters in signs.items():
            at = F.pmod(F.xxhash64("id", i, F.lit(7)), F.lit(len(letters))).cast("int")
            out = F.when(c == sign, F.substring(F.lit(letters), at + 1, F.lit(1))).otherwise(out)
        return out

    rows = rows.withColumn("match", F.array_join(F.transform(F.split("shape", ""), made), ""))
    double = lambda d: F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
    places = F.filter(F.split(F.reverse(digits_of(F.col("match"))), ""), lambda d: d != "")
    total = F.aggregate(F.transform(places, lambda d, i: F.when(i % 2 == 0, double(d)).otherwise(d.cast("int"))), F.lit(0), lambda s, p: s + p)
    right, wrong = F.pmod(-total, F.lit(10)).cast("string"), F.pmod(1 + draw(9, 5) - total, F.lit(10)).cast("string")
    match = F.when(F.contains("match", F.lit("$")), F.replace("match", F.lit("$"), right)).otherwise(F.replace("match", F.lit("!"), wrong))
    mode = F.substring("where", F.pmod(F.xxhash64("id", F.lit(3)), F.length("where")).cast("int") + 1, F.lit(1))
    told = reduce(lambda other, k: F.when(F.col("kind") == k, pick(TELLING[k], 4)).otherwise(other), TELLING, F.lit(""))
    before = F.when(mode == "c", told).when(mode == "n", pick(PLAIN, 5)).otherwise(pick(COUNTER, 6))
    return rows.select("id", "kind", "label", match.alias("match"), before.alias("before"), pick([" and", ".", ", ", " ", "\n", ' "'], 8).alias("after"))


def trained(spark: SparkSession):
    """The boosted trees and each kind's calibrated threshold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = settle(with_features(examples(spark)).repartition(2, "id"), "examples")
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fit = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(4)) > 0
    model = GBTClassifier(maxIter=14, maxDepth=5, stepSize=0.3, seed=7).fit(gather.transform(known.where(fit)))
    held = model.transform(gather.transform(known.where(~fit))).select("kind", "label", vector_to_array("probability")[1].alias("p"))
    ranked = held.groupBy("kind", F.round("p", 4).alias("p")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # at most EXAMPLES / 4 rows
    thresholds = {}
    for kind in EVERY:
        thresholds[kind], good, n = 1.0, 0.0, 0
        for r in sorted((r for r in ranked if r.kind == kind), key=lambda r: -r.p):
            good, n = good + r.good, n + r.n
            if good >= PRECISION * n and r.p > 0.5:
                thresholds[kind] = r.p
    return model, gather, thresholds


def clear_of(every: DataFrame) -> DataFrame:
    """Spans that stay: all base ones, candidates that touch none, and of candidates that overlap each other, from left to
    right, the one with the better score (the earlier one of equals)."""
    ahead = W.partitionBy("rowno").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("rowno").orderBy("end").rangeBetween(W.currentRow, W.unboundedFollowing)
    base = F.col("base")
    # a base span that starts before the candidate's end and ends after its start touches it
    reach = F.max(F.when(base, F.col("end"))).over(ahead)
    inside = F.min(F.when(base, F.col("start"))).over(behind)
    touched = (F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(inside, F.lit(1 << 60)) < F.col("end"))
    kept = settle(every.withColumn("touched", ~base & touched).where("not touched").drop("touched"), "spans")
    order = W.partitionBy("rowno").orderBy("start", "end", "kind")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    opens = (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    islands = kept.where(~base).withColumn("opens", opens).withColumn("island", F.sum("opens").over(order)).groupBy("rowno", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "p"))).alias("s"))
    last = lambda a: F.element_at(a, -1)
    fold = F.aggregate(
        F.slice("s", 2, 1 << 30), F.slice("s", 1, 1),
        lambda a, x: F.when(x["start"] >= last(a)["end"], F.concat(a, F.array(x))).when(x["p"] > last(a)["p"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a),
    )
    chosen = islands.select("rowno", F.explode(F.when(F.size("s") > 1, fold).otherwise(F.col("s"))).alias("x")).select("rowno", "x.kind", "x.start", "x.end", F.lit(False).alias("base"))
    return kept.where(base).select("rowno", "kind", "start", "end", "base").unionByName(chosen)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): all rows of docs, and for each its spans (kind, start, end, base) in DataFrame form."""
    spark = docs.sparkSession
    rows, spans = proposals(docs, id_col, text_col)
    base = spans.where((F.col("source") == "base") & passes(F.col("kind"), F.col("match"))).select("rowno", "kind", "start", "end", F.lit(True).alias("base"), F.lit(2.0).alias("p"))
    wide = spans.where("source <> 'base'")
    from pyspark.ml.functions import vector_to_array

    model, gather, thresholds = trained(spark)
    scored = model.transform(gather.transform(with_features(wide))).select("rowno", "kind", "start", "end", F.lit(False).alias("base"), vector_to_array("probability")[1].alias("p"))
    least = reduce(lambda other, k: F.when(F.col("kind") == k, F.lit(thresholds[k])).otherwise(other), EVERY, F.lit(1.0))
    return rows, clear_of(base.unionByName(scored.where(F.col("p") >= least - 5e-5)))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of these kinds), n_secret and secrets
    (spans of secrets) for each row of docs."""
    rows, spans = personal_data(docs, id_col, text_col)
    rank = F.array_position(F.array(*[F.lit(k) for k in EVERY]), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("start", rank.alias("r"), "end", name.alias("name"), "base")))
    secret = F.col("kind") == "secret"
    each = spans.groupBy("rowno").agg(listed.alias("s"), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], F.count_if(secret).alias("n_secret"))
    out = rows.join(each, "rowno", "left")
    joined = lambda keep: F.coalesce(F.array_join(F.transform(F.filter("s", keep), lambda s: s["name"]), ","), F.lit(""))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(lambda s: s["base"]), 256).alias("base_sha256"), joined(lambda s: s["r"] <= len(KINDS)).alias("spans"), F.coalesce("n_secret", F.lit(0)).cast("long").alias("n_secret"), joined(lambda s: s["r"] > len(KINDS)).alias("secrets"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
