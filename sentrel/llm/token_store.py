"""Token-ID output as a content-addressed store.

Each text is encoded, the end id is appended, and a rolling hash over 16 ids cuts the stream where the content says so.
Chunks are named by the SHA-256 of their ids (little-endian unsigned 32-bit) and stored once; a document is a recipe, the
list of its chunks' names, whose Merkle root is in the recipe; manifest levels hash 1024 roots or nodes each up to one
root of the whole store.

Files below `path`: data/kind=chunk and data/kind=draft (Parquet, written in one pass), recipes (Parquet, ascending
doc_id, with `start`, the ids of all rows before) and manifest (Parquet: level, node, digest). A chunk's payload is zstd
over unsigned 16-bit ids, or 32-bit if any id needs it.

Null is the empty text, whose stream is the end id alone. Rows with one doc_id are kept apart and ordered by length; null
doc_ids come first. Reruns give the same rows."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrel.llm import textkit
from sentrel.llm.common import exclusive_sums, schema, settle, short_batches, work_folder

#: Ids under the rolling hash; least, mean (a power of two) and most ids of a chunk.
SPAN, LEAST, MEAN, MOST = 16, 256, 2048, 8192
#: Units whose ids a worker remembers; beyond, it starts anew.
WORDS = 1_500_000
#: Digests below one node of the manifest.
FAN = 1024

DRAFT = "kind string, key long, doc_id long, n_tokens long, root binary, chunks array<binary>, digest binary, payload binary"
_encoders: dict[str, WordEncoder] = {}  # noqa: F821


class WordEncoder:
    """Ids of UTF-8 texts by the tokenizers library, which sees each different unit once.

    Only ASCII white space ends a word; the vocabulary's pre-tokenizer drops it and joins nothing across it, so words can
    be encoded apart. Words made of Latin letters and plain marks only are cut further where the two meet, as the
    pre-tokenizer does. Units are told apart by 64-bit hashes of their lower-cased bytes (the vocabulary lower-cases). A
    block that holds the string of a special token goes to the library text by text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted(self.library.get_added_tokens_decoder().items())
        self.special = [t.content.encode() for _, t in added]
        apart = [(t.content, i) for i, t in added if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = apart[-1] if apart else None
        self.kind = np.full(256, 3, np.int8)  # 0 white space, 1 letter, 2 plain mark, 3 other
        self.kind[textkit.SPACE] = 0
        self.kind[[*range(65, 91), *range(97, 123)]] = 1
        self.kind[[*b".,!?;:%#&$*|"]] = 2
        self.forget()

    def forget(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of units, sent in runs with a special token between them, which the library never joins to
        its neighbours."""
        if self.mark is None:
            each = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)
        text, code = self.mark
        runs = [text.join(texts[i : i + 1000]) + text for i in range(0, len(texts), 1000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(runs, add_special_tokens=False)])
        ends = np.flatnonzero(ids == code)
        return ids[ids != code], np.diff(np.append(-1, ends)) - 1

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all units."""
        starts, ends, _ = textkit.word_bounds(data, offsets)
        kind = self.kind[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[((data[lead + 1] & 0xC0) == 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        others = np.concatenate([[0], np.cumsum(kind == 3)])
        word = np.zeros(len(data) + 1, np.int8)
        plain = others[ends] == others[starts]
        word[starts[plain]] += 1
        word[ends[plain]] -= 1
        inside = np.cumsum(word, dtype=np.int8)[:-1] > 0
        cut = np.flatnonzero(inside[1:] & inside[:-1] & (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each with the end id, and len+1 offsets."""
        raw = data.tobytes()
        low = raw.lower()
        if any(s.lower() in low for s in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            each = [np.array([*e.ids, end], np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(each), np.cumsum([0, *map(len, each)])
        if len(self.names) > WORDS:
            self.forget()
        starts, ends = self.units(data, offsets)
        names, some, back = np.unique(textkit.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        fresh = np.ones(len(names), bool)
        inner = at < len(self.names)
        fresh[inner] = self.names[at[inner]] != names[inner]
        if fresh.any():
            i = some[fresh]
            ids, n = self.ids_of([low[a:b].decode() for a, b in zip(starts[i].tolist(), ends[i].tolist())])
            self.first = np.insert(self.first, at[fresh], len(self.flat) + np.cumsum(n) - n)
            self.size = np.insert(self.size, at[fresh], n)
            self.names = np.insert(self.names, at[fresh], names[fresh])
            self.flat = np.concatenate([self.flat, ids])
            at = np.searchsorted(self.names, names)
        unit = at[back]
        # the end id of a row follows its last unit
        n = self.size[unit]
        sums = np.concatenate([[0], np.cumsum(n)])
        bounds = np.searchsorted(starts, offsets)
        rows = sums[bounds] + np.arange(len(offsets))
        out = np.full(int(rows[-1]), end, np.uint32)
        body = np.ones(len(out), bool)
        body[rows[1:] - 1] = False
        out[body] = self.flat[np.repeat(self.first[unit] - sums[:-1], n) + np.arange(sums[-1])]
        return out, rows


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk bounds of each row's ids: the rolling hash decides between LEAST and MOST."""
    codes = textkit.mix(ids.astype(np.uint64) + np.uint64(1))
    n = len(ids)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * textkit.powers(textkit.BASE, n), out=sums[1:])
    rolled = np.zeros(n, np.uint64)
    if n >= SPAN:
        rolled[SPAN - 1 :] = (sums[SPAN:] - sums[:-SPAN]) * textkit.powers(textkit.INVERSE, n)[: n - SPAN + 1]
    marks = np.flatnonzero((textkit.mix(rolled) & np.uint64(MEAN - 1)) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        bounds = [a]
        for m in marks[np.searchsorted(marks, a, "right") : np.searchsorted(marks, b, "left")].tolist():
            while m - bounds[-1] > MOST:
                bounds.append(bounds[-1] + MOST)
            if m - bounds[-1] >= LEAST:
                bounds.append(m)
        while b - bounds[-1] > MOST:
            bounds.append(bounds[-1] + MOST)
        if bounds[-1] < b:
            bounds.append(b)
        out.append(bounds)
    return out


def merkle(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = names
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else b""


def pack(ids: np.ndarray, press) -> bytes:
    narrow = ids.max(initial=0) < 1 << 16
    return (b"\2" if narrow else b"\4") + press.compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack(payload: bytes, press) -> np.ndarray:
    return np.frombuffer(press.decompress(payload[1:]), "<u2" if payload[:1] == b"\2" else "<u4").astype("<u4")


def _crc_tables() -> list[list[list[int]]]:
    """For each power of two, byte tables of the linear map that carries a CRC-32 over so many further zero bytes."""
    def times(m: list[int], v: int) -> int:
        out = 0
        for bit in range(32):
            if v >> bit & 1:
                out ^= m[bit]
        return out

    m = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]
    out = []
    for _ in range(48):
        out.append([[times(m, byte << 8 * at) for byte in range(256)] for at in range(4)])
        m = [times(m, x) for x in m]
    return out


_tables: list = []


def crc_join(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of the concatenation of parts given as (bytes, crc)."""
    total = 0
    for size, crc in parts:
        if total:
            if not _tables:
                _tables.extend(_crc_tables())
            power = 0
            while size:
                if size & 1:
                    a, b, c, d = _tables[power]
                    total = a[total & 255] ^ b[total >> 8 & 255] ^ c[total >> 16 & 255] ^ d[total >> 24]
                size >>= 1
                power += 1
        total ^= crc
    return total


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes the store. The payload is shuffled once, by chunk name, after each task has dropped its
    own repeats; a name that many documents share reaches its partition once a task."""

    short_batches(docs.sparkSession)
    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, library = zstandard.ZstdCompressor(level=3), encoder(vocabulary)
        seen: set[bytes] = set()
        for batch in batches:
            for part, data, offsets in textkit.blocks(batch):
                ids, bounds = library.encode(data, offsets, end_id)
                rows: dict[str, list] = {k: [] for k in ("kind", "key", "doc_id", "n_tokens", "root", "chunks", "digest", "payload")}
                for doc, own in zip(part.column(0).to_pylist(), cut(ids, bounds)):
                    names = []
                    for a, b in zip(own, own[1:]):
                        name = hashlib.sha256(ids[a:b].astype("<u4").tobytes()).digest()
                        names.append(name)
                        if name not in seen:
                            if len(seen) < 200_000:
                                seen.add(name)
                            for k, v in zip(rows, ("chunk", int.from_bytes(name[:8], "little", signed=True), None, b - a, None, None, name, pack(ids[a:b], press))):
                                rows[k].append(v)
                    root = merkle(names)
                    for k, v in zip(rows, ("draft", zlib.crc32(root, (doc or 0) & 0xFFFFFFFF), doc, own[-1] - own[0], root, names, None, None)):
                        rows[k].append(v)
                yield pa.record_batch([pa.array(rows["kind"], pa.string()), *(pa.array(rows[k], pa.int64()) for k in ("key", "doc_id", "n_tokens")), pa.array(rows["root"], pa.binary()), pa.array(rows["chunks"], pa.list_(pa.binary())), pa.array(rows["digest"], pa.binary()), pa.array(rows["payload"], pa.binary())], list(rows))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for name in batch.column(6).to_pylist():
                keep.append(name is None or name not in seen)
                if name is not None:
                    seen.add(name)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(draft, schema(DRAFT))
    spark = docs.sparkSession
    rows.repartition("key").mapInArrow(once, schema(DRAFT)).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    drafts = stored(spark, path, "draft").select("doc_id", "n_tokens", "root", "chunks")
    exclusive_sums(drafts, "doc_id", "n_tokens", "start", "root").repartitionByRange(F.col("start")).sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    write_manifest(spark, path)


def stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(schema(DRAFT)).parquet(f"{path}/data").where(F.col("kind") == kind)


def write_manifest(spark: SparkSession, path: str) -> None:
    """Hashes of FAN roots in ascending order of (position div FAN), level by level, up to one root."""
    leaves = spark.read.parquet(f"{path}/recipes").select("start", F.hex("root").alias("digest"), F.lit(1).alias("one"))
    level, depth = exclusive_sums(leaves, "start", "one", "i").select("i", "digest"), 0
    while True:
        grouped = level.groupBy((F.col("i") / FAN).cast("long").alias("node")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("c"))
        depth += 1
        nodes = settle(grouped.select("node", F.sha2(F.array_join(F.col("c.digest"), ""), 256).alias("digest")), "manifest")
        nodes.select(F.lit(depth).alias("level"), "node", "digest").write.mode("append").parquet(f"{path}/manifest")
        if nodes.count() <= 1:
            return
        level = nodes.select(F.col("node").alias("i"), "digest")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents' ids as they were written: doc_id, start, ids array<long>."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [unpack(p, press).astype(np.int64) for p in batch.column(1).to_pylist()]
            yield pa.record_batch({"digest": batch.column(0), "part": pa.array(ids, pa.list_(pa.int64()))})

    parts = stored(spark, path, "chunk").select("digest", "payload").mapInArrow(open_, schema("digest binary, part array<long>"))
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("at", "digest"))
    joined = recipes.join(parts, "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("c"))
    return joined.select("doc_id", "start", F.flatten("c.part").alias("ids"))


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32, n_chunks, verified.

    Every chunk's payload is hashed again and its CRC-32 taken where it lies; documents are put together from their
    recipes' sizes and CRCs, so that no payload moves. verified: all chunks are there, keep their names, and give the
    recipe's Merkle root and length."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            n, crc, good = [], [], []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = unpack(payload, press).tobytes()
                n.append(len(raw) // 4)
                crc.append(zlib.crc32(raw))
                good.append(hashlib.sha256(raw).digest() == name)
            yield pa.record_batch({"digest": batch.column(0), "n": textkit.column_long(n), "crc": textkit.column_long(crc), "good": pa.array(good, pa.bool_())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, crcs, count, ok = [], [], [], []
            for size, root, parts in zip(*(batch.column(k).to_pylist() for k in range(2, 5))):
                total.append(sum(p["n"] or 0 for p in parts))
                crcs.append(crc_join([(4 * (p["n"] or 0), p["crc"] or 0) for p in parts]))
                count.append(len(parts))
                ok.append(all(p["good"] for p in parts) and total[-1] == size and merkle([p["digest"] for p in parts]) == root)
            yield pa.record_batch({"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": textkit.column_long(total), "ids_crc32": textkit.column_long(crcs), "n_chunks": textkit.column_long(count), "verified": pa.array(ok, pa.bool_())})

    chunks = stored(spark, path, "chunk").select("digest", "payload").mapInArrow(facts, schema("digest binary, n long, crc long, good boolean"))
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("at", "digest")).join(chunks, "digest", "left")
    whole = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("at", "digest", "n", "crc", "good"))).alias("parts"))
    return whole.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(fold, schema("doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, verified boolean"))


def token_output(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes docs to a store at path (a fresh shared folder by default) and returns what is read back from it."""
    path = path or work_folder(docs.sparkSession, "tokens")
    write_store(docs, path, vocabulary, end_id)
    return verify_store(docs.sparkSession, path)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
