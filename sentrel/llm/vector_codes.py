"""Product codes of vectors: whole-number Lloyd rounds with Hamerly bounds, a codebook for each part of the vectors.

1. Components become whole numbers, floor(scale * x); a vector is cut into PARTS equal parts. The codebooks start as the
   parts of the ENTRIES smallest vec_ids.
2. A round is one pass over a table that holds, for each vector and part, its entry, one upper bound of the distance to
   that entry and one lower bound of the distance to the second nearest. Entries have moved since, so the upper bound grows
   by the move of its entry and the lower one shrinks by the largest move of another. Only where the upper bound is not
   strictly below the lower one, or below half the way from its entry to the next, the distance to the entry is taken anew,
   and only where it still is not, those to all entries. Bounds are widened by more than doubles can round, and distances are
   whole numbers, so the nearest entry is exact and ties go to the lower index.
3. A task adds up its parts by entry while it goes; sums are merged by a shuffle, so the driver gets one row for each
   entry. Each round's table goes to the shared folder; a lost executor costs only its own tasks.

Vectors that are null, empty, hold null or non-finite components or components of 2**16 and more (their distances would
leave 64 bits), or whose length is no multiple of PARTS are left out, and so are those of another length than that of the
smallest vec_id left. Rows that share a vec_id are coded each on its own; where ids tie, or are null (they come last),
starting points go by their bytes. Fewer than ENTRIES rows make a smaller codebook; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import forget, join_small, schema, settle, short_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of this size and more are left out.
LARGEST = float(1 << 16)
#: More than a few operations on doubles can be off by.
WIDER, TIGHTER = 1 + 1e-12, 1 - 1e-12
#: Doubles hold whole numbers below this.
EXACT = 1 << 53

STATE = "vec_id long, label string, x binary, near binary, upper binary, lower binary, scans int"
SUMS = "part int, entry int, n long, total array<long>"


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < LARGEST)), F.lit(False))


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and x, the components' whole numbers as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            x = np.floor(scale * values).astype("<i4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, pa.py_buffer(x.tobytes())])
            yield pa.record_batch([batch.column(0), batch.column(1), packed], ["vec_id", "label", "x"])

    return vectors.mapInArrow(run, schema("vec_id long, label string, x binary"))


def column_of(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of equal size in a binary column, copied."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def binary_of(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """All squared distances, exact: by doubles where their products and sums are whole numbers in reach."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = float if 4 * top * top * x.shape[1] < EXACT else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]


class Books:
    """The codebooks of a round and what the bounds need of them: the moves since the last, and half the way to the next."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None = None):
        self.books = books
        parts, entries = books.shape[:2]
        was = books if before is None else before
        self.moved = np.sqrt(((books - was).astype(float) ** 2).sum(2)) * WIDER
        order = np.argsort(self.moved, axis=1)
        rows = np.arange(parts)
        top, second = self.moved[rows, order[:, -1]], self.moved[rows, order[:, -2]] if entries > 1 else np.zeros(parts)
        self.others = np.repeat(top[:, None], entries, 1)
        self.others[rows, order[:, -1]] = second
        self.half = np.full((parts, entries), np.inf)
        if entries > 1:
            for p in range(parts):
                gaps = squared(books[p], books[p]).astype(float)
                np.fill_diagonal(gaps, np.inf)
                self.half[p] = np.sqrt(gaps.min(1)) / 2 * TIGHTER


def assign(x: np.ndarray, p: int, now: Books, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Updates the entries and bounds of part p in place; returns the rows that needed a full scan."""
    book = now.books[p]
    upper[:] = (upper + now.moved[p][near]) * WIDER
    lower[:] = lower - now.others[p][near] * WIDER
    lower[:] = np.where(lower > 0, lower * TIGHTER, lower)
    clear = np.maximum(lower, now.half[p][near])
    unsure = np.flatnonzero(~(upper < clear))
    gap = x[unsure] - book[near[unsure]]
    upper[unsure] = np.sqrt((gap * gap).sum(1).astype(float)) * WIDER
    failed = unsure[~(upper[unsure] < clear[unsure])]
    if len(failed):
        d = squared(x[failed], book)
        rows = np.arange(len(failed))
        best = d.argmin(1)
        near[failed] = best
        upper[failed] = np.sqrt(d[rows, best].astype(float)) * WIDER
        rest = d.astype(float)
        rest[rows, best] = np.inf
        lower[failed] = np.sqrt(rest.min(1)) * TIGHTER
    return failed


def passed(state: DataFrame, now: Books, first: bool, last: bool) -> DataFrame:
    """One pass: the new table with the sums of each task as rows behind it, or with last the codes and errors."""
    parts, entries, width = now.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            x = column_of(batch.column(2), "<i4", parts * width).astype(np.int64).reshape(rows, parts, width)
            if first:
                near, upper, lower = np.zeros((rows, parts), np.int32), np.full((rows, parts), np.inf), np.full((rows, parts), -np.inf)
                scans = np.zeros(rows, np.int32)
            else:
                near, upper, lower = (column_of(batch.column(i), k, parts) for i, k in ((3, "<i4"), (4, "<f8"), (5, "<f8")))
                scans = batch.column(6).to_numpy().copy()
            error = np.zeros(rows, np.int64)
            for p in range(parts):
                own = [np.ascontiguousarray(a[:, p]) for a in (x, near, upper, lower)]
                scans[assign(own[0], p, now, *own[1:])] += 1
                near[:, p], upper[:, p], lower[:, p] = own[1:]
                if last:
                    gap = own[0] - now.books[p][own[1]]
                    error += (gap * gap).sum(1)
                else:
                    n[p] += np.bincount(own[1], minlength=entries)
                    one = np.zeros((rows, entries))
                    one[np.arange(rows), own[1]] = 1
                    totals[p] += (one.T @ own[0].astype(float)).astype(np.int64)
            if last:
                code = [bytes(r).hex() for r in near.astype(np.uint8)] if entries <= 256 else ["".join(f"{c:02x}" for c in r) for r in near]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error), pa.array(scans)], ["vec_id", "label", "code", "error", "scans"])
            else:
                none = [pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *map(binary_of, (near, upper, lower)), pa.array(scans), *none], names)
        if not last and n.any():
            at = np.argwhere(n > 0)
            none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.string(), *[pa.binary()] * 4, pa.int32())]
            summed = [pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(n[n > 0]), pa.array(totals[n > 0].tolist(), pa.list_(pa.int64()))]
            yield pa.record_batch([*none, *summed], names)

    names = schema(f"{STATE}, {SUMS}").names
    if last:
        return state.mapInArrow(run, schema("vec_id long, label string, code string, error long, scans int"))
    return state.mapInArrow(run, schema(f"{STATE}, {SUMS}"))


def merged(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after a round: componentwise floor(sum / count); unused entries stay."""
    width = books.shape[2]
    total = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)]
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row for each entry
        out[r.part, r.entry] = np.array([r[f"t{i}"] for i in range(width)], np.int64) // r.n
    return out


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, scans) of each usable row, and the final codebooks by part, entry and position. scans
    counts the full scans of a row's parts over all passes."""
    spark = vectors.sparkSession
    short_batches(spark, 4096)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = settle(whole_numbers(source.where(usable(F.col("v")) & (F.size("v") % parts == 0)), scale), "codes")
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    head = rows.orderBy(*order).select("x").first()
    if head is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long, scans int"), np.zeros((parts, 0, 0), np.int64)
    state = rows.where(F.octet_length("x") == len(head.x))
    seeds = [np.frombuffer(r.x, "<i4").astype(np.int64) for r in state.orderBy(*order).limit(entries).select("x").collect()]  # at most `entries` vectors
    books = np.array(seeds).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    now = Books(books)
    for i in range(rounds):
        after = settle(passed(state, now, i == 0, False), "codes")
        now = Books(merged(after.where("part is not null").select("part", "entry", "n", "total"), now.books), now.books)
        forget(rows)
        rows, state = after, after.where("part is null").select(*schema(STATE).names)
    return passed(state, now, rounds == 0, True), now.books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = settle(found, "coded").withColumns({"__none": F.col("label").isNull(), "__label": F.coalesce("label", F.lit(""))})
    by_label = rows.groupBy("__none", "__label").agg(F.sum("error").alias("label_error"))
    whole = join_small(rows, by_label, ["__none", "__label"])
    return whole.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
