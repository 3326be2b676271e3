"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

1. Each text becomes its set of k-word shingles (64-bit hashes; A-Z lower-cased; words are runs without space and
   \\t..\\r). SAMPLES MinHash values are folded (a) into BANDS keys and (b) into an odd sketch: a bitmap of parities whose
   XOR with another has few ones exactly when most samples agree.
2. Documents with equal sets form a class, of which the smallest doc_id goes on. A band bucket's leader is its smallest
   class. Every class is paired with the smallest of its leaders, and then with those of others that are still in another
   component; pairs whose sizes or sketches rule out the threshold go, the others are confirmed on the full sets.
3. In buckets that still hold more than one component, blocks of classes meet in tasks that test all pairs across
   components and return only links that join them; so no such link is passed over, and no pairs are written out.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8**4)**32 < 5e-8, and the sketch bound lies SIGMAS
standard deviations off.

Null and empty texts have no shingles and are linked with nothing. A text of fewer than k words is one shingle. Rows that
share a doc_id count as one document; a null doc_id is linked with nothing (component_id null, kept true)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import textkit
from sentrel.llm.common import BROADCAST_ROWS, components, forget, schema, settle, short_batches

SAMPLES, BANDS, BITS, SIGMAS = 128, 32, 1024, 6
#: Classes in a block of a bucket.
MEET = 512

_draw = np.random.Generator(np.random.PCG64(977))
MULTIPLIERS = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2)


def sketch_bound(threshold: float) -> int:
    """Most ones in the XOR of two odd sketches of sets at the threshold, with SIGMAS deviations of sampling and folding."""
    agree = SAMPLES * threshold - SIGMAS * math.sqrt(SAMPLES * threshold * (1 - threshold))
    ones = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * (SAMPLES - max(0.0, agree))))
    return math.ceil(ones + SIGMAS)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS) and odd sketches (rows x BITS/64, as int64) of non-empty sets."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    samples = np.empty((SAMPLES, len(sets)), np.uint64)
    for i in range(SAMPLES):
        samples[i] = np.minimum.reduceat(flat * MULTIPLIERS[i] + ADDENDS[i], heads)
    rows = SAMPLES // BANDS
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(sets), 1)
    for r in range(rows):
        keys = textkit.mix(keys * np.uint64(31) + samples[r::rows])
    spots = textkit.mix(samples + np.arange(SAMPLES, dtype=np.uint64)[:, None]) % np.uint64(BITS)
    where = spots.astype(np.int64) + np.arange(len(sets)) * BITS
    parity = np.bincount(where.ravel(), minlength=len(sets) * BITS) & 1
    odd = np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(len(sets), BITS // 64)
    return keys.T.astype(np.int64), odd


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, h1, h2 (a 128-bit name of the shingle set), bands and odd (null for empty sets), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textkit.blocks(batch):
                starts, ends, first = textkit.word_bounds(data, offsets)
                sets = textkit.shingles(textkit.word_hashes(data, starts, ends), first, k)
                n = np.array([len(s) for s in sets], np.int64)
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                full = np.flatnonzero(n)
                bands, odd = np.zeros((0, BANDS), np.int64), np.zeros((0, BITS // 64), np.int64)
                if len(full):
                    some = [sets[i] for i in full]
                    flat, heads = np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])
                    h1[full] = np.add.reduceat(textkit.mix(flat + np.uint64(1)), heads)
                    h2[full] = np.add.reduceat(textkit.mix(flat ^ np.uint64(0x5DEECE66D)), heads)
                    bands, odd = signatures(some)
                lists = []
                for values in (bands, odd):
                    ends_ = np.cumsum((n > 0) * values.shape[1])
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends_]).astype(np.int32)), pa.array(values.ravel())))
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *lists], ["doc_id", "n", "h1", "h2", "bands", "odd"])

    return docs.mapInArrow(run, schema("doc_id long, n long, h1 long, h2 long, bands array<long>, odd array<long>"))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id and its shingle hashes, ascending, as 8-byte words, of the classes in wanted (doc_id, h1, h2, n). Of several
    texts with that doc_id the one whose set is the class's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textkit.blocks(batch):
                starts, ends, first = textkit.word_bounds(data, offsets)
                sets = textkit.shingles(textkit.word_hashes(data, starts, ends), first, k)
                same = []
                for s, n, h1, h2 in zip(sets, *(part.column(c).to_pylist() for c in ("n", "h1", "h2"))):
                    same.append(len(s) == n and tuple(name(s).view(np.int64).tolist()) == (h1, h2))
                yield pa.record_batch({"doc_id": part.column(0), "grams": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(pa.array(same, pa.bool_()))

    few = wanted.count() <= BROADCAST_ROWS
    own = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text", "n", "h1", "h2")
    return own.mapInArrow(run, schema("doc_id long, grams binary")).dropDuplicates(["doc_id"])


def name(grams: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that name a shingle set."""
    return np.array([textkit.mix(grams + np.uint64(1)).sum(), textkit.mix(grams ^ np.uint64(0x5DEECE66D)).sum()], np.uint64)


def ones_between(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = settle(full_sets(docs, wanted(classes, ids), k), "sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    links = settle(pairs.join(right, "b").join(left, "a").select("a", "b", "ga", "gb").mapInArrow(run, schema("u long, v long")), "links")
    forget(sets)
    return links


def wanted(classes: DataFrame, ids: DataFrame) -> DataFrame:
    return settle(classes.select(F.col("rep").alias("doc_id"), "n", "h1", "h2").join(ids, "doc_id", "left_semi"), "wanted")


def plausible(percent: int) -> Column:
    """Whether sizes and odd sketches of x and y leave the threshold possible."""
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    return sizes & (ones_between(F.col("x.odd"), F.col("y.odd")) <= sketch_bound(percent / 100))


def across(open_: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) that join different components inside buckets (key, rep, root, m). Every two blocks of a bucket meet in
    one task, which compares sketches as arrays, confirms on full sets what they leave possible and not yet joined, and
    returns at most one link for each join; a pair counts in the first band that it shares only."""
    bound = sketch_bound(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        rep, root, n = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "root", "n"))
        key, alone = table.column("key")[0].as_py(), table.column("x")[0] == table.column("y")[0]
        own = np.array(table.column("own").to_pylist())
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        odd = np.array(table.column("odd").to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for c in table.column("grams").chunks for g in c]
        parent = {int(r): int(r) for r in root}

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        out = []
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        rows, cols = np.flatnonzero(own == x), np.flatnonzero(own == y)
        for i in rows.tolist():
            js = cols[cols > i] if alone else cols
            js = js[(root[js] != root[i]) & (np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent)]
            js = js[np.bitwise_count(odd[js] ^ odd[i]).sum(1) <= bound]
            if len(js):
                equal = bands[js] == bands[i]
                js = js[bands[js][np.arange(len(js)), equal.argmax(1)] == key]
            for j in js.tolist():
                a, b = find(int(root[i])), find(int(root[j]))
                if a == b:
                    continue
                small, large = (sets[i], sets[j]) if n[i] <= n[j] else (sets[j], sets[i])
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(small) + len(large) - both):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(rep[i]), int(rep[j])))
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(2)], ["u", "v"])

    ids = open_.select(F.col("rep").alias("doc_id")).distinct()
    sets = settle(full_sets(docs, wanted(classes, ids), k).join(classes.select(F.col("rep").alias("doc_id"), "n", "bands", "odd"), "doc_id"), "sets")
    blocks = F.ceil(F.col("m") / MEET).cast("int")
    dealt = open_.withColumns({"own": F.pmod(F.xxhash64("rep"), blocks).cast("int"), "blocks": blocks})
    pairs = F.expr("transform(sequence(0, blocks - 1), j -> named_struct('x', least(own, j), 'y', greatest(own, j)))")
    dealt = dealt.withColumn("t", F.explode(pairs)).select("key", "rep", "root", "own", "t.x", "t.y")
    full = dealt.join(sets, F.col("rep") == F.col("doc_id")).drop("doc_id")
    return full.groupBy("key", "x", "y").applyInArrow(run, schema("u long, v long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; see the module's text."""
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = settle(sketch(docs, k), "sketches")
    named = rows.where("n > 0 and doc_id is not null")
    classes = settle(named.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "bands", "odd")).alias("m"), F.count("*").alias("copies")).select("h1", "h2", "n", F.col("m.doc_id").alias("rep"), "m.bands", "m.odd", "copies"), "classes")
    bands = classes.select("rep", F.explode("bands").alias("key"))
    leaders = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = settle(bands.join(leaders, "key"), "shared")
    facts = classes.select("rep", "n", "odd")
    # rows with one doc_id and different texts are one document
    same = named.select("doc_id", "h1", "h2", "n").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).where("doc_id <> rep")
    same = same.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v").select("u", "v")

    def tested(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(facts.alias("y"), F.col("b") == F.col("y.rep")).join(facts.alias("x"), F.col("a") == F.col("x.rep"))
        return confirm(settle(joined.where(plausible(percent)).select("a", "b"), "pairs"), docs, classes, k, percent)

    # each class with the smallest of its leaders
    first = shared.groupBy("rep").agg(F.min("leader").alias("leader")).where("rep <> leader")
    links = settle(tested(first.select(F.col("leader").alias("a"), F.col("rep").alias("b"))).unionByName(same), "links")
    roots = components(links)
    # with its other leaders, where that could still join components
    tagged = shared.join(roots.withColumnRenamed("root", "r1"), F.col("rep") == F.col("node"), "left").drop("node").join(roots.withColumnRenamed("root", "r2"), F.col("leader") == F.col("node"), "left").drop("node")
    rest = tagged.where(F.coalesce("r1", "rep") != F.coalesce("r2", "leader")).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = settle(links.unionByName(tested(rest.join(first.select(F.col("leader").alias("a"), F.col("rep").alias("b")), ["a", "b"], "left_anti"))), "links")
    roots = components(links)
    # all others of a bucket, across its components, block by block
    tagged = shared.select("key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = tagged.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi and m > 2").select("key", "m")
    open_ = settle(tagged.join(mixed, "key"), "open")
    if not open_.isEmpty():
        links = settle(links.unionByName(across(open_, classes, docs, k, percent)), "links")
        roots = components(links)
    forget(shared)
    whole = rows.join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "rep", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    dropped = settle(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(docs.columns)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)
