"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words of documents and benchmark items are made canonical: numbers become '#', units after numbers '#u', names (words
with a capital that do not begin a sentence) '@', all others lose punctuation at their ends and are lower-cased. Windows of
WIDTH canonical words are hashed and joined. Those with fewer than LITERALS ordinary words are hashed as they are, without
case and punctuation at the ends; they count towards containment only for items that have no other windows, so that new
values in a template lose nothing. Items that have fewer than WIDTH words but WIDTH tokens (sums and the like) are looked
for with their signs, as they are, in a pass of their own.

The matched windows of an item and a document are judged by occurrence: those of one alignment (position in the document
less position in the item), those of a run of alignments at most SHIFT apart (words were put in or left out), and all of
them. An item leaks if one of these is consistent and holds at least LEAK of the item's usable windows, or at least RUN
words in a row at one alignment. Consistent means one to one: each slot (a number, unit or name of the item at its place,
and what the document has there) counts once, and the most frequent partners of the item's values, and those of the
document's values, account for at least CONSISTENT of the slots. Verbatim copies map every value to itself;
re-parameterised ones to another value each. The figures are those of the best occurrence.

The benchmark's windows are broadcast in blocks of at most BROADCAST_WINDOWS; a larger benchmark takes more passes over the
documents (a stated query set against all rows). An item of fewer than WIDTH words is one window of its own length if
LITERALS of them are ordinary (or all of fewer); other items without a usable window ('42') are left out. Null and empty
texts and items match nothing. Rows are told apart by doc_id and text, so rows without an id, and rows that share one, are
judged each by itself; items that share an item_id are taken together.

Items that no document can tell apart form a class: the same canonical words, the same places of equal values, and the
same raw windows. Only one item of a class is looked for, that with the smallest item_id (null last); a row names it and
the number of its class's items, and item_classes() lists them. Thus n documents and m items of one template make n rows,
not n * m."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrel.llm.common import BROADCAST_ROWS, settle

WIDTH, LITERALS, LEAK, CONSISTENT = 5, 2, 0.8, 0.8
RUN, SHIFT = 13, 2
BROADCAST_WINDOWS = 200_000
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi g kg mg lb oz t s sec min h hr hrs ms l ml dl w kw kwh v a hz khz mhz ghz b kb mb gb tb usd eur gbp percent meters metres kilometers miles inches feet hours minutes seconds days weeks months years dollars euros degrees".split()

SPACES = r"[\x20\x09-\x0D]+"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions may use inside lambdas without computing it again for every element: the
    one-row generator keeps the optimizer from merging the projections."""
    return df.select("*", F.explode(F.array(value)).alias(name))


#: What tells documents apart: doc_id (0 for null), whether it is null, and a hash of the text.
DOC = ["d", "nul", "copy"]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    nul = F.col(id_col).isNull()
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d"), nul.alias("nul"), F.xxhash64(text_col).alias("copy"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_canon(df: DataFrame, text: str, signs: bool = False) -> DataFrame:
    """Adds bare and canon, the words of a text without case and punctuation at their ends, and made canonical; with signs
    tokens without letters and digits are kept as words."""
    strip = lambda w: F.regexp_extract(w, r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)
    tokens = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: F.struct(w.alias("raw"), strip(w).alias("bare")))
    df = once(df, "t", F.filter(tokens, lambda p: p["raw" if signs else "bare"] != ""))
    before = F.concat(F.array(F.lit("")), F.col("t.raw"))

    def one(p: Column) -> Column:
        bare = F.when(p["bare"] == "", p["raw"]).otherwise(p["bare"]) if signs else p["bare"]
        low = F.lower(bare)
        digit = (bare >= "0") & (bare < ":")
        named = (bare != low) & (p["before"] != "") & ~p["before"].rlike(r"[.!?:|]$") & (F.substring(bare, 2, 1 << 30) == F.substring(low, 2, 1 << 30))
        unit = low.isin(UNITS) & p["before"].rlike(r"^[^\p{L}\p{N}]*[0-9]")
        canon = F.when(digit, F.lit("#")).when(unit, F.lit("#u")).when(named, F.lit("@")).otherwise(low)
        return F.struct(low.alias("bare"), canon.alias("canon"))

    zipped = F.arrays_zip(F.col("t.raw").alias("raw"), F.col("t.bare").alias("bare"), F.slice(before, 1, F.size("t")).alias("before"))
    df = once(df, "w", F.transform(zipped, one))
    return df.withColumns({"bare": F.col("w.bare"), "canon": F.col("w.canon")}).drop("t", "w")


def with_literal(df: DataFrame) -> DataFrame:
    """Adds literal, whether each canonical word is an ordinary one."""
    return once(df, "literal", F.transform("canon", lambda c: ~c.isin("#", "#u", "@")))


def window_hashes(width: int, signs: bool = False) -> Column:
    """Hashes of the windows of column canon; of column bare where too few words are ordinary (shorter ones stay unused)."""
    parts, bare = (", ".join(f"get({c}, i + {j})" for j in range(width)) for c in ("canon", "bare"))
    if signs:
        hashed = f"xxhash64('signs', {bare})"
    elif width < WIDTH:
        hashed = f"xxhash64({parts})"
    else:
        enough = f"get(literal, i) AND get(literal, i + 1) OR size(filter(slice(literal, i + 1, {width}), x -> x)) >= {LITERALS}"
        hashed = f"if({enough}, xxhash64({parts}), xxhash64('raw', {bare}))"
    return F.expr(f"if(size(canon) >= {width}, transform(sequence(0, size(canon) - {width}), i -> {hashed}), array())")


#: What the texts of items share that are one class; alone is the item where it has several texts.
CLASS = ["canon", "equal", "raw", "alone"]


def item_texts(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, item_id, text, canon, bare, literal of the distinct texts of items, and the columns CLASS."""
    items = benchmark.select(F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string")).alias("item"), F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["item", "text"])
    plain = with_literal(with_canon(items, "text").select("item", "item_id", "text", "canon", "bare"))
    values = F.expr("transform(bare, (b, i) -> if(get(literal, i), '', b))")
    equal = F.expr("transform(values, v -> if(v = '', 0, array_position(values, v)))")
    few = F.expr(f"transform(sequence(0, size(canon) - {WIDTH}), i -> if(size(filter(slice(literal, i + 1, {WIDTH}), x -> x)) >= {LITERALS}, array(''), slice(bare, i + 1, {WIDTH})))")
    usable = F.size(F.filter("literal", lambda x: x)) >= F.least(F.lit(LITERALS), F.size("canon"))
    raw = F.when(F.size("canon") >= WIDTH, few).when(usable & (F.size("canon") > 0), F.array(F.array(F.lit("")))).otherwise(F.array(F.array("text")))
    plain = settle(once(once(plain, "values", values), "equal", equal).withColumn("raw", raw).drop("values"), "items")
    several = plain.groupBy("item").count().where("count > 1").select("item", F.col("item").alias("alone"))
    return settle(plain.join(several, "item", "left"), "items")


def representatives(texts: DataFrame) -> DataFrame:
    """One item of each class, with the columns of item_texts() and items, the number of the class's items."""
    first = F.min_by(F.struct("item", "item_id", "text", "bare", "literal"), F.struct(F.col("item_id").isNull(), "item_id", "item"))
    return texts.groupBy(*CLASS).agg(first.alias("r"), F.count("*").alias("items")).select(*CLASS, "items", "r.*")


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, class_id: each item and the one that stands for its class in leaks(); items of several texts, null and
    empty ones stand for themselves or for their like. Joins on the class's columns, each item's row once."""
    texts = item_texts(benchmark, id_col, text_col)
    known = representatives(texts).select(*CLASS, F.col("item_id").alias("class_id"))
    same = reduce(lambda a, b: a & b, [texts[c].eqNullSafe(known[c]) for c in CLASS])
    return texts.join(known, same).select("item_id", "class_id").distinct()


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, item_id, items, pass, width, at, window, canon, bare, counted of each usable window of the items that stand for
    a class; counted is whether it counts towards containment, pass 1 the items that are looked for with their signs."""
    plain = settle(representatives(item_texts(benchmark, id_col, text_col)), "items")
    out = []
    for width in range(1, WIDTH + 1):
        own = plain.where(F.size("canon") >= WIDTH if width == WIDTH else F.size("canon") == width)
        rows = own.select("item", "item_id", "items", F.lit(0).alias("pass"), F.lit(width).alias("width"), F.posexplode(window_hashes(width)).alias("at", "window"), "canon", "bare", "literal")
        rows = rows.withColumns({c: F.slice(c, F.col("at") + 1, width) for c in ("canon", "bare", "literal")})
        rows = rows.withColumn("template", F.size(F.filter("literal", lambda x: x)) >= min(LITERALS, width)).drop("literal")
        out.append(rows if width == WIDTH else rows.where("template"))
    usable = F.size(F.filter("literal", lambda x: x)) >= F.least(F.lit(LITERALS), F.size("canon"))
    signed = with_canon(plain.where((F.size("canon") < WIDTH) & ~(usable & (F.size("canon") > 0))).select("item", "item_id", "items", "text"), "text", True)
    signed = signed.where(F.size("canon") >= WIDTH).select("item", "item_id", "items", F.lit(1).alias("pass"), F.lit(WIDTH).alias("width"), F.posexplode(window_hashes(WIDTH, True)).alias("at", "window"), "canon", "bare")
    out.append(signed.withColumns({c: F.slice(c, F.col("at") + 1, WIDTH) for c in ("canon", "bare")}).withColumn("template", F.lit(True)))
    rows = settle(reduce(DataFrame.unionByName, out), "windows")
    some = rows.groupBy("item").agg(F.max("template").alias("some"))
    few = some.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(some) if few else some, "item")
    return settle(rows.withColumn("counted", F.col("template") | ~F.col("some")).drop("some", "template"), "windows")


def hashes_of(source: DataFrame, number: int, widths: list[int]) -> DataFrame:
    """DOC and window, the hashes of the windows of all widths of a pass, from one canonicalisation; without places, as
    structs of places cost more than the hashes."""
    rows = with_literal(with_canon(source, "text", number == 1).select(*DOC, "canon", "bare"))
    each = [window_hashes(w, number == 1) for w in widths]
    return rows.select(*DOC, F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("window"))


def windows_of(source: DataFrame, number: int, widths: list[int]) -> DataFrame:
    """DOC, bare, width, at, window: the windows of all widths of a pass, from one canonicalisation."""
    rows = with_literal(with_canon(source, "text", number == 1).select(*DOC, "canon", "bare"))

    def places(width: int) -> Column:
        return F.transform(window_hashes(width, number == 1), lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("at"), h.alias("window")))

    each = [places(w) for w in widths]
    return rows.select(*DOC, "bare", F.explode(F.concat(*each)).alias("w")).select(*DOC, "bare", "w.*")


def passes_of(known: DataFrame) -> dict[int, list[int]]:
    """The widths of each pass; at most WIDTH + 1 rows reach the driver."""
    out: dict[int, list[int]] = {}
    for number, width in sorted(tuple(r) for r in known.select("pass", "width").distinct().collect()):
        out.setdefault(number, []).append(width)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, items, matched, windows, containment, slots, consistency: one row per document and class of leaked
    items, with the class's first item and its number of items."""
    found = leaked(docs, benchmark, id_col, text_col, item_col, item_text)
    return found.select(F.when(~F.col("nul"), F.col("d")).alias("doc_id"), "item_id", "items", "matched", "windows", "containment", "slots", "consistency")


def leaked(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """leaks() with the columns DOC in place of doc_id."""
    known = item_windows(benchmark, item_col, item_text)
    sizes = settle(known.where("counted").groupBy("item").agg(F.count_distinct("window").alias("windows"), F.first("item_id").alias("item_id"), F.first("items").alias("items")), "items")
    keys = settle(known.select("item", "pass", "width", "window", "counted").distinct(), "keys")
    source = numbered(docs, id_col, text_col)
    found = []
    for number, widths in passes_of(keys).items():
        own = keys.where(F.col("pass") == number).select("item", "window", "counted")
        blocks = -(-own.count() // BROADCAST_WINDOWS)
        windows = hashes_of(source, number, widths)
        for i in range(blocks):
            block = own.where(F.pmod(F.hash("window"), F.lit(blocks)) == i)  # about BROADCAST_WINDOWS rows of 17 bytes
            hits = windows.join(F.broadcast(block), "window")
            found.append(settle(hits.groupBy(*DOC, "item").agg(F.count_distinct(F.when(F.col("counted"), F.col("window"))).alias("matched"), F.count("*").alias("met")), "hits"))
    if not found:
        none = {"item_id": benchmark.schema[item_col].dataType, "items": "long", "matched": "long", "windows": "long", "containment": "double", "slots": "long", "consistency": "double"}
        return source.select(*DOC, *[F.lit(None).cast(t).alias(n) for n, t in none.items()]).where("false")
    hits = reduce(DataFrame.unionByName, found).groupBy(*DOC, "item").agg(F.sum("matched").alias("matched"), F.sum("met").alias("met"))
    few = sizes.count() <= BROADCAST_ROWS
    hits = hits.join(F.broadcast(sizes) if few else sizes, "item")
    close = settle(hits.where((F.col("matched") / F.col("windows") >= LEAK) | (F.col("met") > RUN - WIDTH)), "close")
    return occurrences(source, known, close).withColumns({"containment": F.round("containment", 9), "consistency": F.round("consistency", 9)})


def occurrences(source: DataFrame, known: DataFrame, close: DataFrame) -> DataFrame:
    """DOC, item_id, items, matched, windows, containment, slots, consistency of the best occurrence of candidates that leak; only
    documents with a candidate are read again."""
    ids = close.select(*DOC).distinct()
    few = ids.count() <= BROADCAST_ROWS
    texts = source.join(F.broadcast(ids) if few else ids, DOC, "left_semi").dropDuplicates(DOC)
    out = []
    for number, widths in passes_of(known).items():
        rows = windows_of(texts, number, widths)
        rows = rows.select(*DOC, "at", "width", "window", F.slice("bare", F.col("at") + 1, F.col("width")).alias("seen"))
        mine = known.where(F.col("pass") == number).select("item", "width", "window", F.col("at").alias("item_at"), "counted", "canon", F.col("bare").alias("meant"))
        out.append(rows.join(mine, ["width", "window"]).drop("width"))
    key = [*DOC, "item"]
    pairs = settle(reduce(DataFrame.unionByName, out).join(close.select(*key), key).withColumn("line", F.col("at") - F.col("item_at")), "pairs")
    lines = pairs.select(*key, "line").distinct()
    along = W.partitionBy(*key).orderBy("line")
    jump = lines.withColumn("jump", F.coalesce((F.col("line") - F.lag("line").over(along) > SHIFT).cast("int"), F.lit(1)))
    lines = jump.select(*key, "line", F.sum("jump").over(along).alias("near"))
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), n.cast("long").alias("n")) for k, n in ((0, F.lit(0)), (1, F.col("line")), (2, F.col("near")))]))
    parts = pairs.join(lines, [*key, "line"]).select(*key, part.alias("part"), "window", "counted", "at", "item_at", "canon", "meant", "seen")
    shares = parts.groupBy(*key, "part").agg(F.count_distinct(F.when(F.col("counted"), F.col("window"))).alias("matched"))
    cells = parts.select(*key, "part", "at", "item_at", F.posexplode(F.arrays_zip("canon", "meant", "seen")).alias("j", "c")).where(F.col("c.canon").isin("#", "#u", "@"))
    slots = cells.select(*key, "part", (F.col("item_at") + F.col("j")).alias("x"), (F.col("at") + F.col("j")).alias("y"), "c.meant", "c.seen").distinct()
    counts = slots.groupBy(*key, "part", "meant", "seen").count()

    def share(side: str) -> DataFrame:
        top = counts.groupBy(*key, "part", side).agg(F.max("count").alias("top"), F.sum("count").alias("n"))
        return top.groupBy(*key, "part").agg(F.sum("n").alias("slots"), (F.sum("top") / F.sum("n")).alias(f"by_{side}"))

    mapped = share("meant").join(share("seen").drop("slots"), [*key, "part"]).withColumn("consistency", F.least("by_meant", "by_seen"))
    rank = F.dense_rank().over(W.partitionBy(*key, "line").orderBy("at"))
    rows = pairs.select(*key, "line", "at", (F.col("at") - rank).alias("island")).groupBy(*key, "line", "island").agg(F.count_distinct("at").alias("n"))
    runs = rows.groupBy(*key, F.struct(F.lit(1).alias("k"), F.col("line").cast("long").alias("n")).alias("part")).agg((F.max("n") + WIDTH - 1).alias("run"))
    judged = shares.join(mapped, [*key, "part"], "left").join(runs, [*key, "part"], "left").join(close.select(*key, "item_id", "items", "windows"), key)
    judged = judged.withColumns({"containment": F.col("matched") / F.col("windows"), "slots": F.coalesce("slots", F.lit(0)), "consistency": F.coalesce("consistency", F.lit(1.0))})
    judged = judged.where((F.col("consistency") >= CONSISTENT) & ((F.col("containment") >= LEAK) | (F.coalesce("run", F.lit(0)) >= RUN)))
    names = ["containment", "consistency", "slots", "matched", "windows"]
    best = judged.groupBy(*key).agg(F.max(F.struct(*names)).alias("b"), F.first("item_id").alias("item_id"), F.first("items").alias("items"))
    return best.select(*DOC, "item_id", "items", *[f"b.{n}" for n in ("matched", "windows", "containment", "slots", "consistency")])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns."""
    bad = settle(leaked(docs, benchmark, "doc_id", "text", "item_id", "text").select(*DOC).distinct(), "leaks")
    few = bad.count() <= BROADCAST_ROWS
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")]
    bad = bad.toDF(*[f"__{c}" for c in DOC])
    same = reduce(lambda a, b: a & b, [o == bad[f"__{c}"] for o, c in zip(own, DOC)])
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti").select(docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
