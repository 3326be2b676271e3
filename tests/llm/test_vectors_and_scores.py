"""Vector codes, hard negatives and text scores against plain Python, and on nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def clouds(spark):
    """Clusters of vectors with exact copies, ties between entries, repeated and null ids, and vectors that are left out."""
    r = np.random.Generator(np.random.PCG64(5))
    centres = r.normal(0, 0.3, (12, 16))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 12] + r.normal(0, 0.05, 16)], int(i % 6) if i % 17 else None) for i in range(1500)]
    rows += [(2000 + i, rows[i % 40][1], 3) for i in range(300)]
    rows += [(3000, None, 1), (3001, [float("nan")] * 16, 1), (3002, [1.0] * 15 + [None], 1), (3003, [float("inf")] * 16, 2), (3100, [0.5] * 12, 1), (3004, [], 1), (3200, [0.0] * 16, 2), (3201, [0.0] * 16, 2)]
    rows += [(7, [0.25] * 16, 1), (7, [0.25] * 16, 1), (None, [0.125] * 16, 1), (None, [0.125] * 16, None)]
    return spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit(1), "score": F.lit("k"), "near": F.lit(None).cast("int")}).repartition(6)


def coded_by_hand(rows, entries, rounds):
    good = [(i, np.array([math.floor(1024 * x) for x in v], np.int64), lab) for i, v, lab in rows if v and all(x is not None and abs(x) < 2**16 for x in v)]
    good.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1].astype("<i4").tobytes()))
    good = [g for g in good if len(g[1]) == len(good[0][1])]
    x = np.array([g[1] for g in good]).reshape(len(good), 4, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    dist = lambda p: ((x[:, p, None] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        near = [dist(p).argmin(1) for p in range(4)]
        for p in range(4):
            for k in set(near[p].tolist()):
                own = x[near[p] == k, p]
                books[p, k] = own.sum(0) // len(own)
    near = np.array([dist(p).argmin(1) for p in range(4)])
    error = sum(dist(p).min(1) for p in range(4))
    return [(g[0], g[2], bytes(n.astype(np.uint8)).hex(), int(e)) for g, n, e in zip(good, near.T, error)], books


@pytest.mark.parametrize("entries", [256, 20])
def test_codes(spark, clouds, entries):
    from sentrel.llm.vector_codes import vector_codes

    want, books = coded_by_hand([(r.vec_id, r.embedding, r.label) for r in clouds.collect()], entries, 4)
    found, got_books = vector_codes(clouds, entries=entries)
    got = found.collect()
    key = lambda t: str(t)
    assert sorted([(r.vec_id, None if r.label is None else int(r.label), r.code, r.error) for r in got], key=key) == sorted(want, key=key)
    assert (got_books == books).all()
    # five passes of four parts would be 20 full scans a row; the bounds spare most of those after the first
    assert sum(r.scans for r in got) < 0.75 * 20 * len(got)


def test_codes_of_odd_tables(spark, clouds):
    from sentrel.llm.vector_codes import vector_codes

    none, books = vector_codes(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and books.size == 0
    assert vector_codes(clouds.where("vec_id between 3000 and 3004"))[0].count() == 0
    few, books = vector_codes(clouds.where("vec_id < 3"))
    assert books.shape[1] == few.count() == 3
    large = spark.createDataFrame([(i, [float(60_000 * (i % 3) - 60_000 + i)] * 8, i % 2) for i in range(40)], VECTORS)
    want, books = coded_by_hand([(r.vec_id, r.embedding, r.label) for r in large.collect()], 7, 4)
    found, got_books = vector_codes(large, entries=7)
    assert (got_books == books).all() and sorted((r.vec_id, r.code, r.error) for r in found.collect()) == sorted((i, c, e) for i, _, c, e in want)


def test_distances_beyond_doubles():
    from sentrel.llm.vector_codes import squared

    x = np.array([[2**26, -(2**26)], [2**26 - 1, 3]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x]
    assert squared(x, x).tolist() == want


def test_label_errors(spark, tmp_path, clouds):
    from sentrel.llm.vector_codes import op11_vector_codes

    clouds.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_vector_codes(spark, str(tmp_path)).collect()
    want, books = coded_by_hand([(r.vec_id, r.embedding, r.label) for r in clouds.collect()], 256, 4)
    sums = collections.Counter()
    for _, lab, _, e in want:
        sums[lab] += e
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == collections.Counter((i, c, e, sums[lab]) for i, lab, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()}


def mined_by_hand(rows, every, k=5, low=80, high=100):
    good = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < 2**14 for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in good:
        if a[0] % every:
            continue
        near = sorted(((-score(a[2], b[2]), b[0]) for b in good if b != a and b[1] == a[1]))[:k]
        far = sorted((-score(a[2], b[2]), b[0]) for b in good if b[1] != a[1])
        for s, p in near:
            inside = [(n, i) for n, i in far if low * -s <= 100 * -n <= high * -s][:k]
            out += [(a[0], p, r + 1, i, -s, -n) for r, (n, i) in enumerate(inside)]
    return out


@pytest.mark.parametrize("low", [80, 0])
def test_hard_negatives(spark, clouds, monkeypatch, low):
    from sentrel.llm import hard_negatives as H

    monkeypatch.setattr(H, "BUCKET", 100)
    monkeypatch.setattr(H, "ANCHORS", 30)
    rows = clouds.where("vec_id <> 7 or vec_id is null or embedding[0] <> 0.25").unionByName(clouds.where("vec_id = 7 and embedding[0] = 0.25"))
    got = H.hard_negatives(rows, F.col("id") % 50 == 0, low=low).collect()
    want = mined_by_hand([(r.vec_id, r.embedding, r.label) for r in rows.collect()], 50, low=low)
    assert len(want) > 300
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def test_hard_negatives_of_odd_tables(spark, clouds):
    from sentrel.llm.hard_negatives import hard_negatives

    assert hard_negatives(spark.createDataFrame([], VECTORS), F.col("id") % 2 == 0).count() == 0
    assert hard_negatives(clouds, F.col("id") < 0).count() == 0
    # no other row of the label, one label only, negative scores
    lone = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [-1.0, 0.0], 1)], VECTORS)
    assert hard_negatives(lone.where("vec_id < 2"), F.col("id") == 0).count() == 0
    assert hard_negatives(lone, F.col("id") == 0).count() == 0
    assert hard_negatives(lone, F.col("id") == 0, low=100, high=80).count() == 0


def test_pruned_visits():
    import pyarrow as pa

    from sentrel.llm.hard_negatives import visits

    batch = pa.record_batch([pa.array([4.0, 4.0, 0.0, 9.0, 4.0]), pa.array([[6.0], [-math.inf], [1.0], [6.0, 20.0], []])], ["norm", "needs"])
    (out,) = visits(np.array([16.0, 9.0, 4.0, 1.0]), 10)(iter([batch]))
    # the bound 2 * sqrt(top) reaches 6 in two buckets, 3 * sqrt(top) in three; no list and a norm of zero visit nothing
    assert collections.Counter(out.column("bucket").to_pylist()) == {10: 3, 11: 3, 12: 2, 13: 1}


WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def prose(spark):
    """Two made languages, null, empty, blank, very long and repeated texts, upper case, an id twice and one null."""
    r = random.Random(6)
    texts = [" ".join(r.choice(WORDS[:150] if i % 2 else WORDS[150:]) for _ in range(r.randrange(5, 120))) for i in range(600)]
    texts += [None, "", " \n\t", "W1 w1\x0bW2", texts[0], texts[0], "é É Straße", "w3 " * 30_000, "z" * 100_000, "w5\x1cw5 w5 w5"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "w1 lost"), (3, texts[3])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "row": F.lit("r"), "n": F.lit(2)}).repartition(4)


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def left_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.mark.parametrize("head", [1 << 16, 40, 1])
def test_base_scores(spark, prose, head):
    from sentrel.llm.scoring import held_out_by, text_scores

    rows = [(r.doc_id, r.text) for r in prose.collect()]
    c = collections.Counter(w for i, t in rows if not left_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), left_out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    got = text_scores(prose, held_out_by("doc_id"), head=head, rounds=1).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_learns_from_context():
    """Two alternating vocabularies: what stands before tells which; held-out log probabilities rise above the unigrams'."""
    import pyarrow as pa

    from sentrel.llm import scoring as S

    r = np.random.default_rng(4)
    texts = [(r.integers(0, 20, 80) + 20 * (i % 2)).astype("<i4") for i in range(400)]
    mass = np.bincount(np.concatenate(texts), minlength=41).astype(float)
    model = S.start(mass)
    column = lambda t: pa.array([x.tobytes() for x in t], pa.binary())
    target, before, _ = S.positions(column(texts[:300]), 41, S.ORDER)
    held, around, _ = S.positions(column(texts[300:]), 41, S.ORDER)
    t = S.Trainer(model.copy(), (mass + 1) / (mass + 1).sum(), 1)
    for i in range(0, len(target), 256):
        t.step(target[i : i + 256], before[i : i + 256])
    assert S.Normalised(t.m).logs(around, held).mean() > S.Normalised(model).logs(around, held).mean() + 0.2


@pytest.mark.parametrize("kept", [True, False])
def test_probabilities_sum_to_one(spark, prose, kept):
    from sentrel.llm import scoring as S

    docs = prose.select("doc_id", S.held_out_by("doc_id").alias("held_out"), "text")
    counts = S.word_counts(docs.where(~F.col("held_out")).select("text"))
    known = S.lexicon(counts, 100)
    rows = S.encoded(docs, known).cache()
    model = S.trained(rows.where(~F.col("held_out")).select("ids"), S.start(known.mass), known.mass, 0)
    r = np.random.default_rng(1)
    before = r.integers(0, len(known.mass) + 1, (5, S.ORDER))
    normal = S.Normalised(model)
    if not kept:
        normal.kept = None
    for h in before:
        classes = np.arange(len(known.mass))
        share = 10 ** normal.logs(np.repeat(h[None], len(classes), 0), classes)
        assert abs(share.sum() - 1) < 1e-5
        head = (share[known.class_of] * 10**known.share).sum()
        rest = {x.word: x.n for x in counts.collect() if bytes(x.word) not in known.head}
        tail = share[-1] * (sum(n + 1 for n in rest.values()) + 1) / known.rest_size
        assert abs(head + tail - 1) < 1e-5


def test_gradients():
    """One step moves along the numeric gradient of the noise-contrastive likelihood."""
    from sentrel.llm import scoring as S

    mass = np.array([50.0, 30, 20, 5, 5])
    model = S.start(mass, 4)
    target, before = np.array([1, 2, 0, 1]), np.array([[0, 5], [1, 0], [2, 1], [3, 4]])
    p = (mass + 1) / (mass + 1).sum()
    t = S.Trainer(model.copy(), p, 3)
    drawn = np.minimum(np.searchsorted(t.sums, np.random.Generator(np.random.PCG64(3)).random(S.NOISE) * t.sums[-1], side="right"), 4)

    def likelihood(m):
        hat = m.predicted(before).astype(float)
        s = lambda k: hat @ m.outputs[k].T.astype(float) + m.bias[k]
        good = np.diag(s(target)) - np.log(S.NOISE * p[target])
        bad = s(drawn) - np.log(S.NOISE * p[drawn])
        return (-np.log1p(np.exp(-good))).sum() - np.log1p(np.exp(bad)).sum()

    moves = {}
    t.move = lambda name, grad: moves.__setitem__(name, grad)
    t.step(target, before)
    for name in ("inputs", "outputs", "bias", "place"):
        value = getattr(model, name)
        for at in list(np.ndindex(value.shape))[::3]:
            up, down = model.copy(), model.copy()
            getattr(up, name)[at] += 1e-2
            getattr(down, name)[at] -= 1e-2
            slope = (likelihood(up) - likelihood(down)) / 2e-2
            assert abs(moves[name][at] * len(target) - slope) < 2e-2 * max(1, abs(slope)), (name, at)


def test_scores_of_odd_tables(spark, prose):
    from sentrel.llm.scoring import text_scores

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert text_scores(empty, F.lit(False)).count() == 0
    unlearnt = text_scores(prose.where("doc_id < 5"), F.lit(True)).collect()
    assert all((r.base_score, r.n_known, r.train_tokens) == (0, 0, 0) and abs(r.score) < 1e-5 for r in unlearnt) and len(unlearnt) == 6


def test_urls_that_differ_deep_down(spark):
    """A rule labels some of the /bad/ urls below twelve (and thirty) common segments; the others of them are blocked, /good/ not."""
    from sentrel.llm.url_filter import url_verdicts

    for levels in (12, 30):
        common = "/".join(f"s{i}" for i in range(levels))
        urls = [(i, f"http://{'x' if i % 4 else 'y'}.h.org/{common}/{'bad' if i % 2 else 'good'}/p{i // 20}") for i in range(200)]
        rules = [("h.org", f"/{common}/bad/p{k}", "block") for k in range(7)]
        got = {r.page_id: r for r in url_verdicts(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
        assert all(got[i].verdict == "allow" for i, u in urls if "/good/" in u)
        assert all(got[i].verdict == "block" for i, u in urls if "/bad/" in u) and any(got[i].rule is None for i, u in urls if "/bad/" in u)


@pytest.mark.parametrize("ids", ["half null", "seven"])
def test_mix_without_ids(spark, ids):
    """Rows without an id, or with one that many share, are told apart by their texts, so sources reach their targets."""
    from sentrel.llm.mixing import mix

    texts = [" ".join(f"w{i}" for _ in range(40)) for i in range(3000)]
    rows = [(None if ids == "half null" and i % 2 else i if ids == "half null" else i % 7, t, "abc"[i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = mix(df).groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 3000 and len(sums) == 3
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in sums)
