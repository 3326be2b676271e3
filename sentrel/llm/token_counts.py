"""Token counts by finite-state tokenizer compilation.

A sentencepiece BPE model with the identity normaliser is compiled, lazily and exactly, into a deterministic transducer
over characters. The state after a prefix holds, for every start of a piece that may still be going on, the last token
of the encoding up to that start; that is finite because pieces are short. Each transition carries the number of tokens
that the encoding of the prefix gains or loses. Right because a sequence of pieces is the BPE encoding of its text
exactly when every two neighbours are the encoding of theirs, so each prefix has one fitting last token.

Texts are cut into chunks at points where every state agrees (a space that follows another character), so a chunk's
state map is constant: its exit state and count do not depend on the entry. Chunks of one block advance together, one
character a step, as array look-ups, and chunks with equal 64-bit hashes share a walk. Chunks of more than PIECE characters
(text without spaces) are cut into pieces whose maps are worked out for the entry states that can reach them: first for
the state that WARM characters before the piece lead to, then for every exit of the piece before that is new. All pieces
advance together, equal pieces share their maps, and the maps compose by a scan over the chunk's pieces that starts in the
start state; it ends only when each piece's map holds the state that truly enters it, so a wrong guess costs a walk, never
the count.

Null is the empty text and counts 0; rows, columns and repeats are kept as they are (one result per row)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import textkit
from sentrel.llm.common import schema, short_batches

#: Most transducer states kept by a worker; beyond, the table starts anew (results do not change).
MAX_STATES = 250_000
#: Character classes with a column of their own in the table; steps of the others are worked out when met.
CLASSES = 96
#: Characters in a block that advances together.
CHARS = 1 << 21
#: Characters of a piece of a long chunk, and of the run-up that guesses its entry state.
PIECE, WARM = 2048, 48
#: The character that stands for a space in pieces.
MARK = 0x2581

_compiled: dict[str, Transducer] = {}  # noqa: F821


class Transducer:
    """Classes of characters: 0 the space mark, 1-4 unknown ones by their UTF-8 length, 5.. characters of the pieces.

    A state is a row of open starts: node of the piece tree reached from there, last piece before it, and tokens before
    it less tokens now; the longest first, ending with the empty prefix (node 0)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in ordinary]
        self.rank = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        self.wide = max(map(len, self.pieces)) + 1
        nodes: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        for piece in self.pieces:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                edges[nodes[piece[: n - 1]] << 21 | ord(piece[n - 1])] = nodes[piece[:n]]
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int32)
        self.piece_at = np.full(len(nodes), -1, np.int32)
        self.piece_at[[nodes[p] for p in self.pieces]] = np.arange(len(self.pieces))
        self.letters = {p for p in self.pieces if len(p) == 1}
        self.known = np.full(1 << 20, -1, np.int64)
        self.fitting = np.zeros(1 << 20, bool)
        self.n_known = 0
        self.class_of = np.full(0x110000, -1, np.int32)
        self.point_at = np.zeros(0x110000, np.int64)
        self.n_classes = 5
        self.class_of[[0x20, MARK]] = 0
        self.point_at[0] = MARK
        self.codes = textkit.mix(np.arange(1, len(self.letters) + 6, dtype=np.uint64))
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        room = MAX_STATES + (1 << 16)
        self.rows = np.empty((room, 3, self.wide), np.int32)
        self.marked = np.empty(room, bool)
        self.go = np.empty((room, CLASSES), np.int32)
        self.gain = np.empty((room, CLASSES), np.int8)
        self.n_states = 0
        start = np.full((1, 3, self.wide), -1, np.int32)
        start[0, :, 0] = 0, -1, 0
        self.start = int(self.intern(start, np.array([True]))[0])

    def intern(self, rows: np.ndarray, marked: np.ndarray) -> np.ndarray:
        keys = np.concatenate([rows.reshape(len(rows), -1), marked[:, None].astype(np.int32)], 1)
        keys = np.ascontiguousarray(keys).view(f"V{keys.shape[1] * 4}").ravel().tolist()
        out = np.array([self.ids.setdefault(k, -1) for k in keys], np.int64)
        for i in np.flatnonzero(out < 0).tolist():
            at = self.ids[keys[i]]
            if at < 0:
                at = self.ids[keys[i]] = self.n_states
                self.n_states += 1
                if at >= len(self.rows):
                    for name in ("rows", "marked", "go", "gain"):
                        old = getattr(self, name)
                        setattr(self, name, np.concatenate([old, np.empty_like(old)]))
                self.rows[at], self.marked[at], self.go[at] = rows[i], marked[i], -1
            out[i] = at
        return out

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: join the neighbours whose piece has the best score, the leftmost of equals."""
        parts = list(text)
        scores = [self.rank.get(parts[i] + parts[i + 1], -np.inf) for i in range(len(parts) - 1)]
        while scores and (best := max(scores)) > -np.inf:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.rank.get(parts[i - 1] + parts[i], -np.inf)
            if i < len(scores):
                scores[i] = self.rank.get(parts[i] + parts[i + 1], -np.inf)
        return parts

    def fits(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each last piece and piece stay apart and whole as neighbours; worked out once for each two."""
        keys = (last.astype(np.int64) + 1) << 20 | piece
        slot, have = self.lookup(keys)
        if not have.all():
            for k in np.unique(keys[~have]).tolist():
                before, own = (k >> 20) - 1, self.pieces[k & 0xFFFFF]
                want = [own] if before < 0 else [self.pieces[before], own]
                self.keep(k, self.merge("".join(want)) == want)
            slot, have = self.lookup(keys)
        return self.fitting[slot]

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys in an open-addressed table, and whether each is there."""
        size = len(self.known)
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % size
        have = self.known[slot] == keys
        seek = np.flatnonzero(~have & (self.known[slot] >= 0))
        while len(seek):
            slot[seek] = (slot[seek] + 1) % size
            have[seek] = self.known[slot[seek]] == keys[seek]
            seek = seek[~have[seek] & (self.known[slot[seek]] >= 0)]
        return slot, have

    def keep(self, key: int, fit: bool) -> None:
        if self.n_known * 3 > len(self.known):
            old = self.known >= 0
            keys, fits = self.known[old], self.fitting[old]
            self.known, self.fitting = np.full(len(self.known) * 2, -1, np.int64), np.zeros(len(self.known) * 2, bool)
            for k, f in zip(keys.tolist(), fits.tolist()):
                slot = self.place(k)
                self.known[slot], self.fitting[slot] = k, f
        slot = self.place(key)
        self.known[slot], self.fitting[slot] = key, fit
        self.n_known += 1

    def place(self, key: int) -> int:
        slot = ((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40) % len(self.known)
        while self.known[slot] >= 0:
            slot = (slot + 1) % len(self.known)
        return slot

    def classify(self, points: np.ndarray) -> np.ndarray:
        out = self.class_of[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                if chr(p) in self.letters:
                    self.class_of[p] = self.n_classes
                    self.point_at[self.n_classes] = p
                    self.n_classes += 1
                else:
                    self.class_of[p] = len(chr(p).encode("utf-8"))
            out = self.class_of[points]
        return out

    def step(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and tokens gained for each (state, class)."""
        m = len(state)
        point = self.point_at[kind]
        mark, unknown = kind == 0, (kind >= 1) & (kind <= 4)
        rows = self.rows[np.where(mark & ~self.marked[state], self.start, state)]
        node, last, before = rows[:, 0].astype(np.int64), rows[:, 1], rows[:, 2]
        keys = node << 21 | point[:, None]
        at = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
        to = np.where((node >= 0) & (self.edge_keys[at] == keys), self.edge_to[at], -1)
        piece = np.where(to >= 0, self.piece_at[to], -1)
        chosen, gain = np.full(m, -1, np.int64), np.zeros(m, np.int64)
        for slot in range(self.wide):
            open_ = np.flatnonzero((chosen < 0) & (piece[:, slot] >= 0) & ~unknown)
            if len(open_):
                ok = open_[self.fits(last[open_, slot], piece[open_, slot])]
                chosen[ok] = piece[ok, slot]
                gain[ok] = before[ok, slot] + 1
        if ((chosen < 0) & ~unknown).any():
            raise ValueError("the model has no piece for a character that it knows")
        live = to >= 0
        order = np.argsort(~live, axis=1, kind="stable")[:, : self.wide - 1]
        kept = np.take_along_axis(live, order, 1)
        new = np.full((m, 3, self.wide), -1, np.int32)
        for k, values in enumerate((to, last, before - gain[:, None])):
            new[:, k, : self.wide - 1] = np.where(kept, np.take_along_axis(values, order, 1), -1)
        tail = kept.sum(1)
        new[np.arange(m), 0, tail], new[np.arange(m), 1, tail], new[np.arange(m), 2, tail] = 0, chosen, 0
        out = np.full(m, self.start, np.int64)
        if (~unknown).any():
            out[~unknown] = self.intern(new[~unknown], mark[~unknown])
        return out, np.where(unknown, kind, gain)

    def walk(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, entries: list[bytes] | None = None) -> tuple[np.ndarray, list[bytes]]:
        """Tokens of each stretch, and with entries (states as bytes; else the start state) its exit states. The longest
        stretches come first, so that ended ones drop off."""
        order = np.argsort(starts - ends, kind="stable")
        length = (ends - starts)[order]
        at = starts[order]
        state = np.full(len(at), self.start, np.int64) if entries is None else self.states([entries[i] for i in order.tolist()])
        count = np.zeros(len(at), np.int64)
        exits: list[bytes] = [b""] * len(at)
        steps = np.arange(length.max(initial=0) + 1)
        lives = len(length) - np.searchsorted(length[::-1], steps, "right")
        done = len(at)
        for j, live in zip(steps.tolist(), lives.tolist()):
            if entries is not None:
                for i in range(live, done):
                    exits[order[i]] = self.content(int(state[i]))
            done = live
            if not live:
                break
            if self.n_states > MAX_STATES:
                held = [self.content(x) for x in np.unique(state[:live]).tolist()]
                back = np.searchsorted(np.unique(state[:live]), state[:live])
                self.reset()
                state[:live] = self.states(held)[back]
            s, k = state[:live], kinds[at[:live] + j]
            column = np.minimum(k, CLASSES - 1)
            nxt, gain = self.go[s, column].astype(np.int64), self.gain[s, column].astype(np.int64)
            miss = np.flatnonzero((nxt < 0) | (k >= CLASSES - 1))
            if len(miss):
                pairs, back = np.unique(s[miss].astype(np.int64) << 21 | k[miss], return_inverse=True)
                a, b = pairs >> 21, pairs & 0x1FFFFF
                to, got = self.step(a, b)
                usual = b < CLASSES - 1
                self.go[a[usual], b[usual]], self.gain[a[usual], b[usual]] = to[usual], got[usual]
                nxt[miss], gain[miss] = to[back], got[back]
            count[:live] += gain
            state[:live] = nxt
        out = np.empty(len(at), np.int64)
        out[order] = count
        return out, exits

    def content(self, state: int) -> bytes:
        return self.rows[state].tobytes() + (b"\1" if self.marked[state] else b"\0")

    def states(self, contents: list[bytes]) -> np.ndarray:
        rows = np.array([np.frombuffer(c[:-1], np.int32).reshape(3, self.wide) for c in contents], np.int32).reshape(-1, 3, self.wide)
        return self.intern(rows, np.array([c[-1:] == b"\1" for c in contents], bool))

    def long_counts(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of long chunks, from the maps of their pieces."""
        pieces = [(i, p, min(p + PIECE, b)) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())) for p in range(a, b, PIECE)]
        chunk, low, high = (np.array(x, np.int64) for x in zip(*pieces))
        names = [hashlib.blake2b(kinds[p:q].tobytes(), digest_size=16).digest() for _, p, q in pieces]
        first = self.content(self.start)
        _, guesses = self.walk(kinds, np.maximum(starts[chunk], low - WARM), low, [first] * len(pieces))
        maps: dict[tuple[bytes, bytes], tuple[bytes, int]] = {}
        fresh = list(enumerate(guesses))
        while True:
            todo: dict[tuple[bytes, bytes], int] = {}
            for i, entry in fresh:
                if (names[i], entry) not in maps:
                    todo.setdefault((names[i], entry), i)
            if todo:
                at = np.array(list(todo.values()))
                got, exits = self.walk(kinds, low[at], high[at], [entry for _, entry in todo])
                maps |= {key: (e, n) for key, e, n in zip(todo, exits, got.tolist())}
            total, state, missing = np.zeros(len(starts), np.int64), first, np.zeros(len(starts), bool)
            for i, (c, p, _) in enumerate(pieces):
                if p == starts[c]:
                    state = first
                if not missing[c] and (names[i], state) in maps:
                    state, n = maps[names[i], state]
                    total[c] += n
                else:
                    missing[c] = True
            if not missing.any():
                return total
            fresh = [(i + 1, maps[names[i], entry][0]) for i, entry in fresh if i + 1 < len(pieces) and chunk[i + 1] == chunk[i]]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a block of UTF-8 texts."""
        n = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return n
        lead = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        where = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=where[1:])
        rows = where[offsets]
        full = np.flatnonzero(np.diff(rows))
        # the added space in front of each text is one more character of class 0
        kinds = np.insert(self.classify(points), rows[:-1][full], 0)
        heads = rows[:-1][full] + np.arange(len(full))
        sync = np.zeros(len(kinds), bool)
        sync[1:] = (kinds[1:] == 0) & (kinds[:-1] != 0)
        sync[heads] = True
        starts = np.flatnonzero(sync)
        ends = np.append(starts[1:], len(kinds))
        # equal chunks have equal maps: one walk for each different one
        sums = np.zeros(len(kinds) + 1, np.uint64)
        np.cumsum(self.codes[kinds] * textkit.powers(textkit.BASE, len(kinds)), out=sums[1:])
        name = (sums[ends] - sums[starts]) * textkit.powers(textkit.INVERSE, len(kinds))[starts]
        _, some, back = np.unique(name, return_index=True, return_inverse=True)
        long_ = ends[some] - starts[some] > PIECE
        each = np.zeros(len(some), np.int64)
        each[~long_] = self.walk(kinds, starts[some[~long_]], ends[some[~long_]])[0]
        if long_.any():
            each[long_] = self.long_counts(kinds, starts[some[long_]], ends[some[long_]])
        got = each[back]
        n[full] = np.add.reduceat(got, np.searchsorted(starts, heads))
        return n


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    short_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            for part, data, offsets in textkit.blocks(batch, limit=CHARS):
                n = machine.counts(data, offsets)
                yield pa.record_batch({id_col: part.column(0), "n_bytes": textkit.column_long(np.diff(offsets)), "n_tokens": textkit.column_long(n), "over_limit": pa.array(n > limit)})

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, schema(f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
