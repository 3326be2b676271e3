"""Removal of repeated 50-byte strings by two-stage suffix sorting.

A byte goes if some SPAN-byte string that covers it also starts in a document with a smaller doc_id. Comparing all
suffixes of a corpus in one place is impossible, so equal strings are first brought together by content:

1. Each SPAN-byte string is led by the least hash among its GRAM-byte grams (the leftmost of equals). Runs of strings with
   one leader form a context; equal strings have equal leaders, at equal offsets. Documents are dealt into groups of about
   GROUP_BYTES by a hash of the row. A group sends each leader once, as four bytes and the number of its documents, to a
   bucket by leader hash, which answers with the leaders that two documents have, and which of them are hot.
2. Groups send the bytes of contexts with such leaders, each different context once with its smallest document, to buckets
   again. Contexts of a hot leader (HOT documents or more, whatever their edges hold) are sent string by string, dealt by
   the string's own hash, so that no bucket holds a hot leader's edges.
3. A bucket compares bytes: contexts that a smaller document holds whole go. The different contexts of one leader are then
   sorted as suffixes in two stages: suffixes smaller than their successors are sorted directly, all others are induced by
   a scan over first-byte buckets in ascending order. Neighbours with a common prefix of SPAN bytes are equal strings, which
   go in all documents but the smallest.
4. Groups take the spans that go out of their texts.

Nothing goes on a hash alone: hashes only bring strings together. Texts are shuffled once, as all steps read one exchange.
Null is the empty text; rows that share a doc_id never remove from each other, and each is judged by itself. Null doc_ids
count as larger than all others. Texts shorter than SPAN stay whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import textkit
from sentrel.llm.common import schema

SPAN, GRAM, GROUP_BYTES, BUCKET_BYTES = 50, 16, 8 << 20, 8 << 20
#: Documents of a leader from which its strings are dealt one by one.
HOT = 2048
#: Bytes of contexts sorted at a time in step 3, in whole groups of a leader.
SORTED = 1 << 20
#: No context is longer: strings with one leader start within SPAN - GRAM bytes before it.
LONGEST = 2 * SPAN - GRAM
_POSITION = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max

def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start, leader hash and context name of each context in a block, in ascending order."""
    out = []
    n, at = len(data), 0
    inside = np.zeros(n + 1, np.int8)
    size = np.diff(offsets)
    for a, b in zip(offsets[:-1][size >= SPAN].tolist(), offsets[1:][size >= SPAN].tolist()):
        inside[a] += 1
        inside[b - SPAN + 1] -= 1
    valid = np.cumsum(inside, dtype=np.int8)[:n].astype(bool)
    while at + SPAN <= n:
        end = min(n, at + textkit.BLOCK)
        m = end - at
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(textkit.RAW_CODES[data[at:end]] * textkit.powers(textkit.BASE, m), out=sums[1:])
        back = textkit.powers(textkit.INVERSE, m)
        grams = textkit.mix((sums[GRAM:] - sums[:-GRAM]) * back[: m - GRAM + 1])
        key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width, have = SPAN - GRAM + 1, 1
        while have < width:
            step = min(have, width - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        lead = (key & _POSITION).astype(np.int64)  # of each string start 0 .. m - SPAN
        ok = valid[at : at + len(lead)]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (lead[1:] != lead[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (lead[1:] != lead[:-1])
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        name = textkit.mix((sums[b + SPAN] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        out.append((a + at, b + at, grams[lead[a]], name))
        if end == n:
            break
        at = end - SPAN + 1
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def opened(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null: the largest number), UTF-8 bytes and offsets of a group's rows, in an order that every step finds again:
    by id, equal ids by text."""
    ids = texts.column("doc_id").to_numpy(zero_copy_only=False) if not texts.column("doc_id").null_count else np.array([_LAST if i is None else i for i in texts.column("doc_id").to_pylist()])
    ids = ids.astype(np.int64)
    column = texts.column("text").combine_chunks()
    order = np.argsort(ids, kind="stable")
    tied = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    for a in tied[np.append(True, np.diff(tied) > 1)].tolist() if len(tied) else []:
        b = a + 1
        while b + 1 < len(order) and ids[order[b + 1]] == ids[order[a]]:
            b += 1
        order[a : b + 1] = sorted(order[a : b + 1].tolist(), key=lambda i: column[i].as_py() or "")
    data, offsets = textkit.buffers(column.take(pa.array(order)))
    return ids[order], data, offsets


def cut_rows(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """The different keys, ascending, and each column's values of a key as one binary."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    bounds = np.append(heads, len(key))
    return key[order][heads], [packed(c[order], bounds) for c in columns]


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of values[bounds[i] : bounds[i + 1]]."""
    ends = pa.array((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] numbers for each i."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def asked(buckets: int):
    """Step 1 of a group: its leaders and their numbers of documents, by bucket."""

    def run(texts: pa.Table) -> pa.Table:
        ids, data, offsets = opened(texts)
        first, _, lead, _ = contexts(data, offsets)
        doc = ids[np.searchsorted(offsets, first, "right") - 1]
        order = np.lexsort((doc, lead))
        lead, doc = lead[order], doc[order]
        head = np.append(True, lead[1:] != lead[:-1]) if len(lead) else np.zeros(0, bool)
        fresh = head.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        n = np.diff(np.append(np.cumsum(fresh)[head] - 1, fresh.sum()))
        lead = lead[head]
        key, columns = cut_rows((lead % np.uint64(buckets)).astype(np.int64), [(lead >> np.uint64(32)).astype(np.uint32), np.minimum(n, 65535).astype(np.uint16)])
        return pa.table([pa.array(key.astype(np.int32)), pa.array(np.full(len(key), texts.column("home")[0].as_py(), np.int32)), *columns], ["bucket", "home", "lead", "docs"])

    return run


def answered(hot: int):
    """Step 1 of a bucket: for each group its leaders that two documents have (or two groups, which is nearly the same),
    and those that are hot."""

    def run(table: pa.Table) -> pa.Table:
        sizes = np.array([len(x) // 4 for x in table.column("lead").to_pylist()], np.int64)
        lead, docs = joined(table, "lead", np.uint32), joined(table, "docs", np.uint16)
        home = np.repeat(table.column("home").to_numpy(), sizes)
        _, back = np.unique(lead, return_inverse=True)
        many = np.bincount(back, docs).astype(np.int64)[back] if len(lead) else np.zeros(0, np.int64)
        keep = many > 1
        key, columns = cut_rows(home[keep].astype(np.int64), [lead[keep], (many[keep] >= hot).astype(np.uint8)])
        bucket = pa.array(np.full(len(key), table.column("bucket")[0].as_py(), np.int32))
        return pa.table([pa.array(key.astype(np.int32)), bucket, *columns], ["home", "bucket", "lead", "hot"])

    return run


def distinct(payload: np.ndarray, head: np.ndarray, size: np.ndarray, lead: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of contexts that brings those with equal bytes and leader together, smallest document first, and whether
    each has the bytes of the one before it. Hashes make the order, bytes decide."""
    order = np.lexsort((doc, name, lead))
    same = np.zeros(len(order), bool)
    if len(order):
        a, b = order[1:], order[:-1]
        same[1:] = (lead[a] == lead[b]) & (name[a] == name[b]) & (size[a] == size[b])
        spots = np.flatnonzero(same)
        for at in range(0, len(spots), 1 << 16):
            own = spots[at : at + (1 << 16)]
            x, y = order[own], order[own - 1]
            n = size[x]
            differ = payload[spread(head[x], n)] != payload[spread(head[y], n)]
            same[own[np.add.reduceat(differ, np.cumsum(n) - n) > 0]] = False
    return order, same


def named(payload: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of at most LONGEST bytes, whose heads and ends ascend."""
    out, at, ends = np.zeros(len(head), np.uint64), 0, head + size
    while at < len(head):
        end = max(at + 1, int(np.searchsorted(ends, head[at] + textkit.BLOCK, "right")))
        lo, hi = head[at], ends[end - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(textkit.RAW_CODES[payload[lo:hi]] * textkit.powers(textkit.BASE, hi - lo), out=sums[1:])
        a, b = head[at:end] - lo, ends[at:end] - lo
        out[at:end] = (sums[b] - sums[a]) * textkit.powers(textkit.INVERSE, hi - lo)[a] + (b - a).astype(np.uint64)
        at = end
    return textkit.mix(out)


SENT = "bucket int, home int, lead binary, size binary, doc binary, row binary, at binary, bytes binary, n binary"


def sent(buckets: int):
    """Step 2 of a group: different contexts with their smallest documents by bucket, and what goes inside the group, which
    passes under a number of its own below 0."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        if not texts.num_rows:
            return schema_table(SENT)
        ids, data, offsets = opened(texts)
        first, last, lead, _ = contexts(data, offsets)
        wanted, hot = joined(answers, "lead", np.uint32), joined(answers, "hot", np.uint8)
        # a bucket decides for all groups alike on a leader's upper half; leaders of two buckets may share that
        own = np.repeat(answers.column("bucket").to_numpy(), [len(x) // 4 for x in answers.column("lead").to_pylist()])
        wanted = wanted.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        short = lead >> np.uint64(32) << np.uint64(32) | lead % np.uint64(buckets)
        at = np.minimum(np.searchsorted(wanted, short), max(0, len(wanted) - 1))
        found = wanted[at] == short if len(wanted) else np.zeros(len(short), bool)
        first, last, lead, dealt = first[found], last[found], lead[found], (hot[at[found]] > 0) if len(wanted) else np.zeros(0, bool)
        # strings of hot leaders one by one
        n = (last - first + 1)[dealt]
        single = spread(first[dealt], n)
        head = np.concatenate([first[~dealt], single])
        size = np.concatenate([(last - first)[~dealt] + SPAN, np.full(len(single), SPAN)]).astype(np.int64)
        order = np.argsort(head, kind="stable")
        head, size = head[order], size[order]
        name = named(data, head, size)
        lead = np.concatenate([lead[~dealt], np.zeros(len(single), np.uint64)])[order]
        lead = np.where(order >= len(lead) - len(single), name, lead)
        row = np.searchsorted(offsets, head, "right") - 1
        order, same = distinct(data, head, size, lead, name, ids[row])
        head, size, lead, row, doc = head[order], size[order], lead[order], row[order], ids[row[order]]
        least = doc[np.flatnonzero(~same)][np.cumsum(~same) - 1] if len(doc) else doc
        gone = doc > least
        keep = np.flatnonzero(~gone)
        bucket = (lead[keep] % np.uint64(buckets)).astype(np.int64)
        keep = keep[np.lexsort((head[keep], bucket))]
        bucket = (lead[keep] % np.uint64(buckets)).astype(np.int64)
        key, columns = cut_rows(bucket, [(lead[keep] >> np.uint64(32)).astype(np.uint32), size[keep].astype(np.uint8), doc[keep], row[keep].astype(np.uint32), (head[keep] - offsets[row[keep]]).astype(np.uint32)])
        bounds = np.append(np.searchsorted(bucket, key), len(bucket))
        blobs = [press.compress(data[spread(head[keep[a:b]], size[keep[a:b]])].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        home = texts.column("home")[0].as_py()
        none = pa.array([None] * len(key), pa.binary())
        out = pa.table([pa.array(key.astype(np.int32)), pa.array(np.full(len(key), home, np.int32)), *columns, pa.array(blobs, pa.binary()), none], SENT_NAMES)
        if gone.any():
            inside = [np.ascontiguousarray(c).tobytes() for c in (row[gone].astype(np.uint32), (head[gone] - offsets[row[gone]]).astype(np.uint32), (size[gone] - SPAN + 1).astype(np.uint8))]
            own = [pa.array([-1 - home], pa.int32()), pa.array([home], pa.int32()), *[pa.array([x], pa.binary()) for x in (None, None, None, inside[0], inside[1], None, inside[2])]]
            out = pa.concat_tables([out, pa.table(own, SENT_NAMES)])
        return out

    return run


SENT_NAMES = [f.split()[0] for f in SENT.split(", ")]


def schema_table(text: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema(text)).empty_table()


def settled(table: pa.Table) -> pa.Table:
    """Step 3 of a bucket: for each group the rows (numbers in the group), places and numbers of strings that go."""
    inside = table.column("lead").null_count == table.num_rows
    if inside:
        return table.select(["home", "row", "at", "n"])
    import zstandard

    press = zstandard.ZstdDecompressor()
    counts = np.array([len(x) for x in table.column("size").to_pylist()], np.int64)
    payload = np.frombuffer(b"".join(press.decompress(x) for x in table.column("bytes").to_pylist()), np.uint8)
    home = np.repeat(table.column("home").to_numpy(), counts)
    lead, size, doc = joined(table, "lead", np.uint32), joined(table, "size", np.uint8).astype(np.int64), joined(table, "doc", np.int64)
    row, at = joined(table, "row", np.uint32), joined(table, "at", np.uint32)
    head = np.cumsum(size) - size
    order, same = distinct(payload, head, size, lead, named(payload, head, size), doc)
    top = np.flatnonzero(~same)
    which = np.cumsum(~same) - 1
    owner = doc[order[top]]
    gone = doc[order] > owner[which]
    out = [(order[gone], at[order[gone]], size[order[gone]] - SPAN + 1)]
    # leaders with several contexts of several documents are sorted
    group_of = lead[order[top]]
    cuts = np.flatnonzero(np.append(True, group_of[1:] != group_of[:-1]))
    bounds = np.append(cuts, len(top))
    look = np.flatnonzero((np.diff(bounds) > 1) & (np.maximum.reduceat(owner, cuts) > np.minimum.reduceat(owner, cuts))) if len(cuts) else cuts
    begun, held = [], 0
    rank = np.append(top, len(order))
    for g in [*look.tolist(), None]:
        if g is None or held >= SORTED:
            if begun:
                hits = repeated([payload[head[i] : head[i] + size[i]].tobytes() for i in order[top[begun]].tolist()], owner[begun])
                for t, starts in zip(begun, hits):
                    if len(starts):
                        for i in order[rank[t] : rank[t + 1]].tolist():
                            if doc[i] == owner[t]:
                                out.append((np.full(len(starts), i), at[i] + starts, np.ones(len(starts), np.int64)))
            begun, held = [], 0
        if g is not None:
            begun.extend(range(bounds[g], bounds[g + 1]))
            held += int(size[order[top[bounds[g] : bounds[g + 1]]]].sum())
    entry, place, n = (np.concatenate([o[k] for o in out]) for k in range(3))
    key, columns = cut_rows(home[entry].astype(np.int64), [row[entry], place.astype(np.uint32), n.astype(np.uint8)])
    return pa.table([pa.array(key.astype(np.int32)), *columns], ["home", "row", "at", "n"])


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, right to a depth of 56 bytes at least; the text must end with a byte larger than any other.

    S-type suffixes (smaller than their successors) are sorted directly by 56-byte keys; then buckets of first bytes are
    scanned in ascending order and each takes its L-type suffixes in the order of their successors, all ranked by then."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    differ = np.flatnonzero(text[1:] != text[:-1])
    ahead = np.searchsorted(differ, np.arange(n - 1))
    rising = np.zeros(n, bool)
    some = ahead < len(differ)
    where = differ[ahead[some]]
    rising[:-1][some] = text[where + 1] > text[where]
    small = np.flatnonzero(rising)
    keys = [key_words(padded, small, w) for w in range(7)]
    small = small[np.lexsort(keys[::-1])]
    heads = np.zeros(257, np.int64)
    np.cumsum(np.bincount(text, minlength=256), out=heads[1:])
    rank = np.full(n, -1, np.int64)
    n_large = np.bincount(text[~rising], minlength=256)
    first = text[small]
    slot = np.arange(len(small)) - np.searchsorted(first, first)
    rank[small] = heads[first] + n_large[first] + slot
    large = np.flatnonzero(~rising)
    large = large[np.argsort(text[large], kind="stable")]
    bounds = np.searchsorted(text[large], np.arange(257))
    follows = np.append(text[1:], 0)
    for c in range(256):
        own = large[bounds[c] : bounds[c + 1]]
        if not len(own):
            continue
        at = heads[c]
        level = own[(follows[own] < c) | (own == n - 1)]
        level = level[np.argsort(np.where(level == n - 1, -1, rank[np.minimum(level + 1, n - 1)]), kind="stable")]
        while len(level):
            rank[level] = at + np.arange(len(level))
            at += len(level)
            before = level[level > 0] - 1  # runs of one byte: the next level stands before this one
            level = before[(text[before] == c) & ~rising[before]]
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def key_words(padded: np.ndarray, at: np.ndarray, word: int) -> np.ndarray:
    """Eight bytes from each position as one big-endian number."""
    key = np.zeros(len(at), np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[at + 8 * word + j]
    return key


def worth_sorting(texts: list[bytes]) -> list[tuple[int, int]]:
    """For each context the bounds of its part between the first and last string whose hash another start has too. Equal
    strings have equal hashes, so nothing that repeats lies outside; (0, 0) where nothing can."""
    size = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts), np.uint8)
    head = np.cumsum(size) - size
    n = size - SPAN + 1
    start = spread(head, n)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(textkit.RAW_CODES[text] * textkit.powers(textkit.BASE, len(text)), out=sums[1:])
    name = (sums[start + SPAN] - sums[start]) * textkit.powers(textkit.INVERSE, len(text))[start]
    order = np.argsort(name)
    equal = name[order][1:] == name[order][:-1]
    often = np.zeros(len(name), bool)
    often[order[1:][equal]] = often[order[:-1][equal]] = True
    cuts = np.cumsum(n) - n
    place = start - np.repeat(head, n)
    low = np.minimum.reduceat(np.where(often, place, 1 << 40), cuts)
    high = np.maximum.reduceat(np.where(often, place, -1), cuts)
    return [(a, b + SPAN) if b >= 0 else (0, 0) for a, b in zip(low.tolist(), high.tolist())]


def repeated(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each context, the starts of SPAN-byte strings that a context of a smaller document holds too."""
    bounds = worth_sorting(texts)
    some = [i for i, (a, b) in enumerate(bounds) if b]
    out = [np.zeros(0, np.int64)] * len(texts)
    if some:
        for i, starts in zip(some, sorted_repeats([texts[i][slice(*bounds[i])] for i in some], docs[some])):
            out[i] = starts + bounds[i][0]
    return out


def sorted_repeats(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """The same for all that the contexts hold, by neighbours in the order of their suffixes."""
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    size = np.array([len(t) for t in texts])
    head = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    order = sort_suffixes(text)
    owner = np.searchsorted(head, order, "right") - 1
    full = order + SPAN <= head[owner] + size[owner]
    order, owner = order[full], owner[full]
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    same = np.ones(max(0, len(order) - 1), bool)
    for w in range(7):
        words = key_words(padded, order, w)
        words = words >> np.uint64(48) if w == 6 else words
        same &= words[1:] == words[:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    least = np.full(int(group[-1]) + 1 if len(group) else 0, _LAST)
    np.minimum.at(least, group, docs[owner])
    hit = docs[owner] > least[group]
    hit_owner, hit_at = owner[hit], order[hit] - head[owner[hit]]
    by = np.argsort(hit_owner, kind="stable")
    cuts = np.searchsorted(hit_owner[by], np.arange(len(texts) + 1))
    return [hit_at[by[cuts[i] : cuts[i + 1]]] for i in range(len(texts))]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def taken_out(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Step 4 of a group."""
    if not texts.num_rows:
        return schema_table(RESULT)
    ids, data, offsets = opened(texts)
    row, at, n = joined(answers, "row", np.uint32), joined(answers, "at", np.uint32).astype(np.int64), joined(answers, "n", np.uint8).astype(np.int64)
    change = np.zeros(len(data) + 1, np.int32)
    start = offsets[row] + at
    np.add.at(change, start, 1)
    np.add.at(change, start + n - 1 + SPAN, -1)
    gone = np.cumsum(change)[:-1] > 0
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = gone[edges]
    removed, spans = (np.diff(np.append(0, np.cumsum(x))[offsets]) for x in (gone, first))
    rows = [hashlib.sha256((data[a:b][~gone[a:b]] if r else data[a:b]).tobytes()).hexdigest() for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist())]
    return pa.table([pa.array(ids, mask=ids == _LAST), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(rows, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; see the module's text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes, buckets = max(16, -(-size // GROUP_BYTES)), max(16, -(-size // BUCKET_BYTES))
    texts = source.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(homes)).cast("int").alias("home"), "doc_id", "text")
    grouped = texts.groupBy("home")
    leads = grouped.applyInArrow(asked(buckets), schema("bucket int, home int, lead binary, docs binary"))
    answers = leads.groupBy("bucket").applyInArrow(answered(hot), schema("home int, bucket int, lead binary, hot binary"))
    strings = grouped.cogroup(answers.groupBy("home")).applyInArrow(sent(buckets), schema(SENT))
    going = strings.groupBy("bucket").applyInArrow(settled, schema("home int, row binary, at binary, n binary"))
    return grouped.cogroup(going.groupBy("home")).applyInArrow(taken_out, schema(RESULT))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
