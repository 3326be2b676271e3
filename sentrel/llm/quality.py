"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic
calibration.

STATISTICS of each whole text (character classes, word lengths, repetition, lines) are standardised and mapped to FEATURES
cosines that approximate a Gaussian kernel. Partitions of the labelled rows sum Z'Z and Z'y for each of FOLDS folds; the
driver solves FEATURES x FEATURES systems only. Scores of each fold by the model without it are calibrated by pooling
adjacent violators; the final score interpolates between the pools.

Training takes at most SAMPLE labelled rows, chosen by a hash of doc_id; everything else covers all rows. Ids, labels,
languages and sources are not inputs of a score. Null is the empty text and gets a score as any other. Labels that are
null are no labels; several of one doc_id are averaged. Without labelled rows every score is 0.5, and with labels of one
value only, that value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import textkit
from sentrel.llm.common import schema, settle, short_batches

#: Most labelled rows that training reads, cosines, folds, ridge weight per row.
SAMPLE, FEATURES, FOLDS, RIDGE = 20_000, 256, 4, 1e-4
CUT = 0.7

_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "high": [*range(128, 256)],
    "end": [*b".?"], "bang": [*b"!"], "comma": [*b",;:"], "bar": [*b"|"], "mark": [*b"#$%&*<>=@^_~\\{}[]+/"], "quote": [*b"\"'()-"],
    "space": [0x20], "line": [0x0A],
}
STATISTICS = [*_CLASSES, "bytes", "words", "word_bytes", "word_spread", "long_words", "distinct_words", "top_word", "distinct_triples", "distinct_lines", "line_words"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x STATISTICS of a block of texts."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.full(256, len(_CLASSES), np.int64)
    for i, members in enumerate(_CLASSES.values()):
        kinds[members] = i
    row_of = np.repeat(np.arange(rows), size)
    table = np.bincount(row_of * (len(_CLASSES) + 1) + kinds[data], minlength=rows * (len(_CLASSES) + 1)).reshape(rows, -1)
    starts, ends, first = textkit.word_bounds(data, offsets)
    n_words = np.diff(first)
    length = (ends - starts).astype(float)
    word_row = np.repeat(np.arange(rows), n_words)
    words = textkit.word_hashes(data, starts, ends)
    per = lambda values: np.bincount(word_row, values, minlength=rows)
    some = np.maximum(n_words, 1)
    mean = per(length) / some
    spread = np.sqrt(np.maximum(per(length**2) / some - mean**2, 0))
    triples = words.copy()
    triples[:-2] = textkit.mix(words[:-2] * np.uint64(3) + textkit.mix(words[1:-1] * np.uint64(5) + words[2:])) if len(words) > 2 else triples[:-2]
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    edges = edges[edges < len(data)]
    lines = textkit.word_hashes(data, edges, np.append(edges[1:], len(data))) if len(edges) else np.zeros(0, np.uint64)
    line_first = np.searchsorted(edges, offsets)
    out = np.zeros((rows, len(STATISTICS)))
    out[:, : len(_CLASSES)] = table[:, :-1] / np.maximum(size, 1)[:, None]
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b > a:
            own = np.sort(words[a:b])
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            t = np.sort(triples[a:b])
            out[i, -5] = len(new) / (b - a)
            out[i, -4] = np.diff(np.append(new, b - a)).max() / (b - a)
            out[i, -3] = (1 + np.count_nonzero(t[1:] != t[:-1])) / (b - a)
        c, d = line_first[i], line_first[i + 1]
        if d > c:
            out[i, -2] = len(np.unique(lines[c:d])) / (d - c)
            out[i, -1] = np.log1p((b - a) / (d - c))
    out[:, -10], out[:, -9], out[:, -8], out[:, -7] = np.log1p(size), np.log1p(n_words), mean, spread
    out[:, -6] = per((length > 12).astype(float)) / some
    return np.sqrt(np.maximum(out, 0))


class Model:
    """Standardisation, cosines, weights and calibration; a few hundred KB whatever the corpus."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        draw = np.random.Generator(np.random.PCG64(4242))
        self.mean, self.scale = mean, scale
        self.turn = draw.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.phase), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.cosines(x) @ self.weights
        # a hundredth of the raw score keeps the order inside a pool
        return np.clip(0.99 * np.interp(raw, self.at, self.value) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def pool(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: mean score and mean label of each pool, ascending."""
    blocks: list[list[float]] = []
    for s, y in sorted(zip(scores.tolist(), labels.tolist())):
        blocks.append([s, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, y2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model on docs' rows that have a label and are not held out."""
    short_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textkit.blocks(batch):
                x = statistics(data, offsets)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    labelled = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")  # at most SAMPLE ids
    rows = settle(labelled.mapInArrow(measure, schema("doc_id long, y double, x array<double>")).repartition(8), "labelled")
    width = len(STATISTICS)
    stats = rows.agg(F.count("*"), *[F.avg(F.col("x")[i]) for i in range(width)], *[F.stddev_pop(F.col("x")[i]) for i in range(width)]).first()
    if not stats[0]:
        return Model(np.zeros(width), np.ones(width))
    model = Model(np.array(stats[1 : 1 + width]), np.maximum(np.array(stats[1 + width :]), 1e-6))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            ids, y, x = (np.array(batch.column(i).to_pylist()) for i in range(3))
            if len(x):
                z = model.cosines(x)
                for f in range(FOLDS):
                    own = ids // 4 % FOLDS == f
                    total[f] += z[own].T @ np.hstack([z[own], y[own, None]])
        yield pa.record_batch({"s": pa.array([total.tobytes()], pa.binary())})

    folds = sum(np.frombuffer(r.s, float).reshape(FOLDS, FEATURES + 1, FEATURES + 2) for r in rows.coalesce(8).mapInArrow(sums, schema("s binary")).collect())

    def solve(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[:, :-1] + RIDGE * max(1.0, total[-1, -2]) * np.eye(FEATURES + 1), total[:, -1])

    each = np.array([solve(folds.sum(0) - folds[f]) for f in range(FOLDS)])

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y, x = (np.array(batch.column(i).to_pylist()) for i in range(3))
            if len(x):
                raw = (model.cosines(x) * each[ids // 4 % FOLDS]).sum(1)
                yield pa.record_batch({"s": pa.array(raw), "y": pa.array(y)})

    pairs = rows.mapInArrow(out_of_fold, schema("s double, y double")).collect()  # at most SAMPLE pairs of numbers
    model.weights = solve(folds.sum(0))
    model.at, model.value = pool(np.array([p.s for p in pairs]), np.array([p.y for p in pairs]))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textkit.blocks(batch):
                yield pa.record_batch([part.column(0), pa.array(model.score(statistics(data, offsets)))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, schema("doc_id long, score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches CUT, with all their columns; scored where they lie, without a join."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(batch.columns, [str(i) for i in range(len(names))])
            for part, data, offsets in textkit.blocks(plain, str(at)):
                good = pa.array(model.score(statistics(data, offsets)) >= CUT)
                yield pa.RecordBatch.from_arrays(part.columns, names).filter(good)

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
