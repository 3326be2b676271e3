"""Scores of texts by a log-bilinear model of word classes, trained by noise-contrastive estimation, beside a smoothed
unigram score.

1. Words are counted over all training documents, one row for each word of a task, merged by a shuffle. The most frequent
   words, at most HEAD (of at most LONGEST bytes each, equally frequent ones together), are known to every task; all others
   are met by a join on the word.
2. Classes follow frequency: CLASSES * N ** (1/4) of them for N training tokens; the most frequent words have one each,
   the rest of the head shares classes of equal mass, and one class holds all other words and what was never seen. So the
   model, like the counts, grows with the corpus. A word's probability is that of its class, given the classes of the
   ORDER words before it, times its smoothed share of its class.
3. The class model predicts a vector, the sum of the vectors of the words before, each component weighted by position; a
   class scores the inner product with its own vector and a bias. Training goes over all training documents, ROUNDS
   times: each task trains numpy copies of the model on its own documents by noise-contrastive estimation (NOISE classes
   drawn from the unigram distribution for each step), and rows are averaged by how often a task touched them. The driver
   gets one row for each class.
4. Scoring takes matrix products of many contexts with all classes and normalises each row exactly; equal contexts of a
   task share a row.

Words are runs other than the six ASCII white-space characters, A-Z folded; each document ends in one end token. Null is
empty: only the end token. A document without id counts as id '' and is trained on. Rows that repeat count each time.
Without training documents every probability is 1 over the one class. Scores depend on how the documents are dealt to
tasks, as each trains on its own share; counts and base scores do not."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import forget, schema, settle, short_batches

HEAD, LONGEST = 1 << 16, 64
CLASSES, WIDTH, ORDER = 8, 16, 2
ROUNDS, NOISE, STEP, RATE = 1, 32, 1024, 0.5
#: Words that a task counts before it hands them on, and positions of one product.
FLUSH, CHUNK = 400_000, 512
#: Contexts whose normalisers a task keeps; with more possible ones, each batch takes those of its own different contexts.
KEPT = 1 << 24
END = b"\n"


def words_of(column: pa.Array) -> Iterator[list[bytes]]:
    """The tokens of each text: folded words and the end."""
    for text in pc.fill_null(column, "").cast(pa.binary()).to_pylist():
        words = text.lower().split()
        words.append(END)
        yield words


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n over a table with one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for words in words_of(batch.column(0)):
                counts.update(words)
                if len(counts) > FLUSH:
                    yield out()
        if counts:
            yield out()

    return texts.mapInArrow(run, schema("word binary, n long")).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What every task knows: class, count and share (log10) of each head word, and the sizes of the classes."""

    head: dict[bytes, int]  # word -> rank
    class_of: np.ndarray
    count: np.ndarray
    share: np.ndarray
    mass: np.ndarray  # tokens of each class; the last class is that of the rest
    rest_words: int
    total: int
    distinct: int

    @property
    def rest_size(self) -> float:
        """Tokens and words of the last class, with one place for words never seen."""
        return float(self.mass[-1]) + self.rest_words + 1


def lexicon(counts: DataFrame, head: int = HEAD) -> Lexicon:
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("step", F.floor(F.log2("n") * 16))
    steps, taken, least = short.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect(), 0, None  # a few hundred
    for r in steps:
        taken += r.words
        if taken > head:
            break
        least = r.step
    rows = [] if least is None else short.where(F.col("step") >= least).select("word", "n").collect()  # at most HEAD words of LONGEST bytes
    rows.sort(key=lambda r: (-r.n, bytes(r.word)))
    words, n = [bytes(r.word) for r in rows], np.array([r.n for r in rows], np.int64)
    classes = max(1, min(len(words), int(CLASSES * max(facts.total, 1) ** 0.25)))
    single = min(len(words), classes * 3 // 4)
    class_of = np.arange(len(words))
    if len(words) > single:
        behind = n[single:].sum()
        shared = max(1, classes - single)
        class_of[single:] = single + np.minimum(shared - 1, (np.cumsum(n[single:]) - n[single:]) * shared // max(1, behind))
        class_of = np.unique(class_of, return_inverse=True)[1]
    own = int(class_of.max(initial=-1)) + 1
    mass = np.bincount(class_of, weights=n, minlength=own + 1).astype(np.int64)
    size = np.bincount(class_of, minlength=own + 1)
    mass[own] = facts.total - n.sum()
    share = np.log10((n + 1) / (mass[class_of] + size[class_of])) if len(words) else np.zeros(0)
    return Lexicon({w: i for i, w in enumerate(words)}, class_of, n, share, mass, facts.distinct - len(words), facts.total, facts.distinct)


def encoded(docs: DataFrame, known: Lexicon) -> DataFrame:
    """Per document the classes of its tokens as bytes, sums over its head words, and its other words with their numbers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known.head, known.class_of.astype(np.int32), np.log10(known.count + 1.0), known.share))
    rest = len(known.mass) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, class_of, logs, share = shared.value
        class_of, get = np.append(class_of, np.int32(rest)), head.get
        logs, share, out = np.append(logs, 0.0), np.append(share, 0.0), len(head)
        for batch in batches:
            ids, n, known_n, base, inner, others = [], [], [], [], [], []
            for words in words_of(batch.column(2)):
                rank = np.array([get(w, out) for w in words], np.int64)
                ids.append(class_of[rank].tobytes())
                n.append(len(words))
                known_n.append(int((rank < out).sum()))
                base.append(float(logs[rank].sum()))
                inner.append(float(share[rank].sum()))
                others.append([{"word": w, "n": c} for w, c in Counter(words[i] for i in np.flatnonzero(rank == out)).items()])
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()), pa.array(inner, pa.float64()), pa.array(others, kind)], names)

    shape = schema("doc_id long, held_out boolean, ids binary, n_tokens long, n_head long, base double, inner double, others array<struct<word: binary, n: int>>")
    names = shape.names
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, shape)


@dataclass
class Model:
    """inputs: a vector for each class and one for before the start; outputs, bias by class; place: weights by position."""

    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    def copy(self) -> Model:
        return Model(*(a.copy() for a in (self.inputs, self.outputs, self.bias, self.place)))

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return np.einsum("tod,od->td", self.inputs[before], self.place)


def start(mass: np.ndarray, width: int = WIDTH, order: int = ORDER) -> Model:
    """The unigram model: small random vectors, biases as the classes' smoothed shares."""
    r = np.random.Generator(np.random.PCG64(13))
    n = len(mass)
    bias = np.log((mass + 1.0) / (mass.sum() + n))
    return Model(r.normal(0, 0.1, (n + 1, width)).astype("f4"), r.normal(0, 0.1, (n, width)).astype("f4"), bias.astype("f4"), np.full((order, width), 1 / order, "f4"))


def positions(column: pa.Array, classes: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token classes, classes before each, first token of each text) over a batch; `classes` stands before a start."""
    texts = [np.frombuffer(b, "<i4") for b in column.to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = np.full(order, classes, np.int32)
    whole = np.concatenate([x for t in texts for x in (pad, t)]) if texts else np.zeros(0, np.int32)
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat((np.arange(len(texts)) + 1) * order, sizes)
    return whole[at], np.stack([whole[at - i - 1] for i in range(order)], 1) if len(at) else np.zeros((0, order), np.int32), first


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row number, as a sorted reduction."""
    out = np.zeros((n, values.shape[1]), "f4")
    if len(rows):
        order = np.argsort(rows.astype(np.int16) if n < 1 << 15 else rows, kind="stable")  # short integers sort by radix
        sorted_ = rows[order]
        begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        out[sorted_[begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


class Trainer:
    """Adaptive gradient steps of noise-contrastive estimation on one task's documents."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m, self.log_noise, self.sums = model, np.log(noise).astype("f4"), np.cumsum(noise)
        self.r = np.random.Generator(np.random.PCG64(seed))
        self.square = Model(*(np.full_like(a, 1e-2) for a in (model.inputs, model.outputs, model.bias, model.place)))
        self.touched_in, self.touched_out, self.steps = np.zeros(len(model.inputs)), np.zeros(len(model.outputs)), 0

    def move(self, name: str, grad: np.ndarray) -> None:
        """One step along a gradient of the log likelihood."""
        square, value = getattr(self.square, name), getattr(self.m, name)
        square += grad * grad
        value += RATE * grad / np.sqrt(square)

    def step(self, target: np.ndarray, before: np.ndarray) -> None:
        m, n = self.m, len(self.m.outputs)
        drawn = np.minimum(np.searchsorted(self.sums, self.r.random(NOISE) * self.sums[-1], side="right"), n - 1)
        vectors = m.inputs[before]
        hat = np.einsum("tod,od->td", vectors, m.place)
        shift = math.log(NOISE)
        good = (hat * m.outputs[target]).sum(1) + m.bias[target] - self.log_noise[target] - shift
        bad = hat @ m.outputs[drawn].T + (m.bias[drawn] - self.log_noise[drawn] - shift)
        g_good = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        g_bad = -1 / (1 + np.exp(-np.clip(bad, -30, 30)))
        d_hat = g_good[:, None] * m.outputs[target] + g_bad @ m.outputs[drawn]
        rows = np.concatenate([target, drawn])
        d_out = scatter(rows, np.concatenate([g_good[:, None] * hat, g_bad.T @ hat]), n)
        d_bias = np.bincount(rows, np.concatenate([g_good, g_bad.sum(0)]), n).astype("f4")
        d_in = scatter(before.ravel(), (d_hat[:, None] * m.place[None]).reshape(-1, d_hat.shape[1]), n + 1)
        d_place = np.einsum("td,tod->od", d_hat, vectors)
        scale = np.float32(1 / len(target))
        for name, grad in (("inputs", d_in), ("outputs", d_out), ("bias", d_bias), ("place", d_place)):
            self.move(name, grad * scale)
        self.touched_out += np.bincount(rows, minlength=n)
        self.touched_in += np.bincount(before.ravel(), minlength=n + 1)
        self.steps += 1


def trained(ids: DataFrame, model: Model, mass: np.ndarray, turn: int) -> Model:
    """One pass over the training documents; every task starts from the model, rows are averaged by their touches."""
    classes, order = len(model.outputs), len(model.place)
    noise = (mass + 1.0) / (mass.sum() + classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(model.copy(), noise, 1_000 + turn)
        for batch in batches:
            target, before, _ = positions(batch.column(0), classes, order)
            mixed = t.r.permutation(len(target))
            for i in range(0, len(target), STEP):
                some = mixed[i : i + STEP]
                t.step(target[some], before[some])
        if not t.steps:
            return
        m, kinds = t.m, []
        for kind, rows, weight in (("i", m.inputs, t.touched_in), ("o", np.column_stack([m.outputs, m.bias]), t.touched_out), ("p", m.place, np.full(order, float(t.steps)))):
            kinds += [(kind, i, float(weight[i]), (rows[i].astype(float) * weight[i]).tolist()) for i in np.flatnonzero(weight)]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*kinds), (pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], ["kind", "i", "weight", "v"])

    made = ids.mapInArrow(run, schema("kind string, i int, weight double, v array<double>"))
    total = [F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(model.outputs.shape[1] + 1)]
    out = model.copy()
    for r in made.groupBy("kind", "i").agg(F.sum("weight").alias("weight"), *total).collect():  # a row or two for each class
        v = np.array([r[f"v{j}"] or 0.0 for j in range(len(total))]) / r.weight
        if r.kind == "o":
            out.outputs[r.i], out.bias[r.i] = v[:-1], v[-1]
        else:
            (out.inputs if r.kind == "i" else out.place)[r.i] = v[:-1]
    return out


class Normalised:
    """log10 probabilities of classes after contexts, normalised over all classes. A context's normaliser is a row of a
    product of many different contexts with all classes; positions that share a context share it."""

    def __init__(self, model: Model):
        self.m, self.base, order = model, len(model.outputs) + 1, len(model.place)
        self.powers = self.base ** np.arange(order, dtype=np.int64)
        self.kept = np.full(self.base**order, np.nan) if self.base**order <= KEPT else None

    def normalisers(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes))
        for i in range(0, len(codes), CHUNK):
            before = codes[i : i + CHUNK, None] // self.powers % self.base
            s = self.m.predicted(before) @ self.m.outputs.T + self.m.bias
            top = s.max(1, keepdims=True)
            out[i : i + CHUNK] = top[:, 0] + np.log(np.exp(s - top).sum(1, dtype=float))
        return out

    def logs(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        codes = before.astype(np.int64) @ self.powers
        if self.kept is not None:
            new = np.unique(codes[np.isnan(self.kept[codes])])
            self.kept[new] = self.normalisers(new)
            norm = self.kept[codes]
        else:
            each, at = np.unique(codes, return_inverse=True)
            norm = self.normalisers(each)[at]
        own = (self.m.predicted(before) * self.m.outputs[target]).sum(1, dtype=float) + self.m.bias[target]
        return (own - norm) / math.log(10)


def class_scores(rows: DataFrame, model: Model) -> DataFrame:
    """Adds class_score to rows whose first column is ids."""
    order = len(model.place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normalised(model)
        for batch in batches:
            found = []
            for i in range(0, len(batch), 64):
                target, before, first = positions(batch.column(0).slice(i, 64), len(model.outputs), order)
                found.append(np.add.reduceat(normal.logs(before, target), first))
            columns = [*batch.columns[1:], pa.array(np.concatenate(found) if found else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "class_score"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[1:])
    return rows.mapInArrow(run, schema(f"{kinds}, class_score double"))


def text_scores(docs: DataFrame, held_out: Column, head: int = HEAD, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; see the module's text."""
    spark = docs.sparkSession
    short_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = settle(word_counts(source.where(~F.col("held_out")).select("text")), "words")
    known = lexicon(counts, head)
    rows = settle(encoded(source, known).withColumn("row", F.monotonically_increasing_id()), "classes")
    model = start(known.mass)
    for turn in range(rounds if known.total else 0):
        model = trained(rows.where(~F.col("held_out")).select("ids"), model, known.mass, turn)
    scored = class_scores(rows.select("ids", "row", "doc_id", "held_out", "n_tokens", "n_head", "base", "inner"), model)
    rest = F.lit(math.log10(known.rest_size))
    if known.rest_words:
        # words beyond the head are rare in training, so no word of the counts is hot; adaptive joins split one that only other documents repeat
        met = rows.select("row", F.explode("others").alias("o")).select("row", F.col("o.word").alias("word"), F.col("o.n").alias("m")).join(counts, "word")
        found = met.groupBy("row").agg(F.sum("m").alias("n_rest"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("logs"))
        scored = scored.join(found, "row", "left")
    else:
        scored = scored.withColumns({"n_rest": F.lit(None).cast("long"), "logs": F.lit(None).cast("double")})
    logs = F.coalesce("logs", F.lit(0.0))
    room = known.total + known.distinct + 1  # base probabilities are (c + 1) / room; with nothing learnt (0 + 1) / 1
    base = F.col("base") + logs - F.col("n_tokens") * F.lit(math.log10(room))
    score = F.col("class_score") + F.col("inner") + logs - (F.col("n_tokens") - F.col("n_head")) * rest
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def held_out_by(id_col: str, modulus: int = 7, left: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == left


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return text_scores(docs, held_out_by("doc_id"))
