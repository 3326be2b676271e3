"""Hard negatives of anchors: exact inner-product search in buckets of falling norm.

1. Components become whole numbers, floor(scale * x). Rows are sorted by norm and cut into buckets of BUCKET rows.
2. Buckets are visited in waves of growing length, those of the largest norms first. By Cauchy and Schwarz an anchor can
   reach no score above its own norm times the largest norm of a bucket; it visits a bucket only if that reaches its lower
   limit: the score of the last one that it has so far where its list is full, and for negatives at least the lower end of
   the window. A wave in which nobody visits anything ends the search, as later norms are no larger.
3. A task holds at most ANCHORS anchors and one bucket, takes their product in doubles (exact: whole numbers below 2**53,
   else by integers) and returns the best few rows of each list; lists are merged in the shared folder after each wave, by
   a rank of which each task first keeps its own best.

The first pass finds an anchor's positives: the best other rows of its label. The second finds, for each different score of
a positive, the best rows of other labels between `low` and `high` hundredths of it. Higher scores come first, then smaller
ids. Nothing is capped or approximate: an anchor gets `positives` times `negatives` rows, or all that there are.

Rows with a null id or label, a null vector, or a component that is null, not finite or of 2**14 and more (scores would
leave 64 bits) take no part. Of vectors of different length the shorter one counts as if it ended in zeros; an empty one
scores 0 with all. Rows that repeat in id, label and vector count once; rows that share only the id are told apart, and
where scores and ids tie, a hash of label and vector decides. A negative or zero positive score has the window that the two
inequalities leave (for the usual 80 and 100: none, and 0 alone)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrel.llm.common import exclusive_sums, forget, schema, settle, short_batches
from sentrel.llm.vector_codes import EXACT, whole_numbers

BUCKET, ANCHORS, CHUNK = 4096, 8192, 512
#: Buckets of the first wave; each wave is GROWTH times as long as all before it, up to LONGEST buckets.
FIRST, GROWTH, LONGEST = 2, 3, 4096
LARGEST = float(1 << 14)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of 32-bit integers as 64-bit ones, with zeros behind the short ones."""
    out = np.zeros((len(column), width), np.int64)
    for i, b in enumerate(column.to_pylist()):
        own = np.frombuffer(b, "<i4")
        out[i, : len(own)] = own
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; sums on the way stay below the product of the norms."""
    most = math.sqrt(float((a.astype(float) ** 2).sum(1).max(initial=0)) * float((b.astype(float) ** 2).sum(1).max(initial=0)))
    return (a.astype(float) @ b.T.astype(float)) if most < EXACT / 2 else (a @ b.T).astype(float)


def best(scores: np.ndarray, hits: np.ndarray, k: int, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best hits of each row: by score, then id, then tag."""
    if scores.shape[1] > k:
        crowded = np.flatnonzero(hits.sum(1) > k)
        if len(crowded):
            part = np.where(hits[crowded], scores[crowded], -np.inf)
            at = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
            hits[crowded] &= scores[crowded] >= at[:, None]
    r, c = np.nonzero(hits)
    order = np.lexsort((tags[c], ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    begin = np.searchsorted(r, r, side="left")
    keep = np.arange(len(r)) - begin < k
    return r[keep], c[keep]


def visit(k: int, positives: bool):
    """A task: the anchors (side 0) of a block against the rows (side 1) of a bucket."""
    names = ["anchor", "atag", "goal", "score", "id", "tag"]

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        anchors, rows = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not len(anchors) or not len(rows):
            return pa.table([pa.array([], pa.int64())] * 6, names)
        width = max(len(b) for b in table.column("x").to_pylist()) // 4
        b, ids, tags = matrix(rows.column("x"), width), rows.column("id").to_numpy(), rows.column("tag").to_numpy()
        labels = {v: i for i, v in enumerate(dict.fromkeys(table.column("label").to_pylist()))}
        coded = lambda t: np.array([labels[v] for v in t.column("label").to_pylist()])
        b_label, out = coded(rows), []
        for at in range(0, len(anchors), CHUNK):
            some = anchors.slice(at, CHUNK)
            own_id, own_tag = some.column("id").to_numpy(), some.column("tag").to_numpy()
            scores = products(matrix(some.column("x"), width), b)
            same = coded(some)[:, None] == b_label[None]
            goals, needs = some.column("goals").to_pylist(), some.column("needs").to_pylist()
            if positives:
                open_ = same & ~((own_id[:, None] == ids[None]) & (own_tag[:, None] == tags[None]))
                sets = [(np.zeros(len(some), np.int64), scores >= np.array([n[0] for n in needs])[:, None])]
            else:
                open_, sets = ~same, []
                for j in range(max(map(len, goals))):
                    goal = np.array([g[j] if j < len(g) else 0 for g in goals], np.int64)
                    low = np.array([n[j] if j < len(g) else np.inf for n, g in zip(needs, goals)])
                    high = np.array([g[j] if j < len(g) else -np.inf for g in some.column("tops").to_pylist()])
                    sets.append((goal, (scores >= low[:, None]) & (scores <= high[:, None])))
            for goal, hits in sets:
                r, c = best(scores, hits & open_, k, ids, tags)
                out.append((own_id[r], own_tag[r], goal[r], scores[r, c].astype(np.int64), ids[c], tags[c]))
        return pa.table([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(6)], names)

    return run


def visits(tops: np.ndarray, first: int):
    """Deals each anchor to those buckets of a wave that it may find something in; tops falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch.column(batch.schema.get_field_index("norm")).to_numpy().astype(float)
            least = np.array([min(n, default=np.inf) for n in batch.column(batch.schema.get_field_index("needs")).to_pylist()], float)
            # the bound is widened by more than doubles can round; a need of 0 or less is always in reach
            reach = np.where(least > 0, least * least / np.maximum(norm, 1e-300) * (1 - 1e-9), -1.0)
            n = np.searchsorted(-tops, -reach, side="right")
            n[np.isposinf(least)] = 0
            keep = np.repeat(np.arange(len(batch)), n)
            bucket = first + np.arange(len(keep)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, pa.array(bucket.astype(np.int64))], [*batch.schema.names, "bucket"])

    return run


def search(anchors: DataFrame, rows: DataFrame, tops: DataFrame, buckets: int, k: int, positives: bool, needs) -> DataFrame:
    """anchor, atag, goal, score, id, tag: the k best rows of each list. needs(found) gives the anchors with the columns
    goals, tops (upper ends) and needs (lower limits) as the lists found so far make them."""
    spark, kind = anchors.sparkSession, "anchor long, atag long, goal long, score long, id long, tag long"
    found = settle(spark.createDataFrame([], kind), "found")
    at, length = 0, FIRST
    top = W.partitionBy("anchor", "atag", "goal").orderBy(F.desc("score"), "id", "tag")
    while at < buckets:
        to = min(buckets, at + length)
        wave = [math.inf] * (to - at)
        for r in tops.where(f"bucket >= {at} and bucket < {to}").collect():  # at most LONGEST numbers
            wave[r.bucket - at] = r.top
        armed = needs(found)
        kinds = ", ".join(f"{n} {t}" for n, t in armed.dtypes)
        dealt = settle(armed.mapInArrow(visits(np.array(wave, float), at), schema(f"{kinds}, bucket long")), "visits")
        pairs = dealt.groupBy("block", "bucket").agg(F.count("*").alias("n"))
        if dealt.isEmpty():
            break
        own = dealt.select("block", "bucket", F.lit(0).alias("side"), "id", "tag", "label", "x", "goals", "tops", "needs")
        met = rows.where(f"bucket >= {at} and bucket < {to}").join(pairs, "bucket")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("goals", "array<long>"), ("tops", "array<double>"), ("needs", "array<double>"))]
        other = met.select("block", "bucket", F.lit(1).alias("side"), "id", "tag", "label", "x", *none)
        new = own.unionByName(other).groupBy("block", "bucket").applyInArrow(visit(k, positives), schema(kind))
        ranked = found.unionByName(new).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")
        after = settle(ranked, "found")
        forget(dealt)
        found, at, length = after, to, min(LONGEST, GROWTH * to)
    return found


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor is a condition on the column id;
    see the module's text."""
    spark = vectors.sparkSession
    short_batches(spark, 4096)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    taken = whole_numbers(source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good), scale).distinct()

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [float((np.frombuffer(x, "<i4").astype(float) ** 2).sum()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm, pa.float64()), pa.array([-int(n) for n in norm], pa.int64())], ["id", "label", "x", "norm", "falling"])

    normed = taken.mapInArrow(norms, schema("id long, label string, x binary, norm double, falling long"))
    plain = settle(normed.withColumns({"tag": F.xxhash64("label", "x"), "one": F.lit(1).cast("long"), "mixed": F.xxhash64("id", "label", "x")}), "normed")
    rows = settle(exclusive_sums(plain, "falling", "one", "place", "mixed").withColumn("bucket", F.floor(F.col("place") / BUCKET)).select("id", "tag", "label", "x", "norm", "bucket"), "buckets")
    forget(plain)
    tops = settle(rows.groupBy("bucket").agg(F.max("norm").alias("top")), "tops")
    buckets = (tops.agg(F.max("bucket").alias("b")).first().b or 0) + 1
    asked = rows.where(anchor).drop("bucket")
    blocks = max(1, -(-asked.count() // ANCHORS))
    asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).cast("long")), "anchors")
    key = [F.col("id") == F.col("anchor"), F.col("tag") == F.col("atag")]

    def for_positives(found: DataFrame) -> DataFrame:
        full = found.groupBy("anchor", "atag").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        need = F.when(F.col("n") >= positives, F.col("last").cast("double")).otherwise(F.lit(-math.inf))
        return asked.join(full, key, "left").select(*asked.columns, F.array(F.lit(0).cast("long")).alias("goals"), F.array(F.lit(math.inf)).alias("tops"), F.array(F.coalesce(need, F.lit(-math.inf))).alias("needs"))

    chosen = settle(search(asked, rows, tops, buckets, positives, True, for_positives).drop("goal"), "positives")
    floored = lambda whole: F.expr(f"(({whole}) - pmod({whole}, 100)) div 100")
    ends = {"low_end": -floored(f"-score * {low}"), "high_end": floored(f"score * {high}")}
    goals = chosen.select("anchor", "atag", F.col("score").alias("goal"), *[c.cast("double").alias(n) for n, c in ends.items()]).distinct()
    goals = settle(goals.where("low_end <= high_end"), "goals")

    def for_negatives(found: DataFrame) -> DataFrame:
        full = found.groupBy("anchor", "atag", "goal").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        need = F.when(F.col("n") >= negatives, F.greatest(F.col("last").cast("double"), "low_end")).otherwise(F.col("low_end"))
        each = goals.join(full, ["anchor", "atag", "goal"], "left").select("anchor", "atag", F.struct("goal", F.col("high_end").alias("top"), need.alias("need")).alias("g"))
        lists = each.groupBy("anchor", "atag").agg(F.array_sort(F.collect_list("g")).alias("g"))  # at most `positives` each
        return asked.join(lists, key).select(*asked.columns, F.col("g.goal").alias("goals"), F.col("g.top").alias("tops"), F.col("g.need").alias("needs"))

    mined = search(asked, rows, tops, buckets, negatives, False, for_negatives)
    by = W.partitionBy("anchor", "atag", "goal").orderBy(F.desc("score"), "id", "tag")
    ranked = mined.withColumn("rank", F.row_number().over(by)).select("anchor", "atag", "goal", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    mates = chosen.select("anchor", "atag", F.col("score").alias("goal"), F.col("id").alias("positive_id"))
    return mates.join(ranked, ["anchor", "atag", "goal"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("goal").alias("positive_score"), "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)
