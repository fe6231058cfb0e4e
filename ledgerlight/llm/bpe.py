"""Byte-level BPE encoding and decoding with published merge ranks.

A text is cut by the tokenizer's pattern; a piece that is in the vocabulary is one token, any other starts as single bytes
and is merged. New pieces of a run are merged together: they are sorted into buckets of similar length, each bucket is a
padded numpy matrix, and in each round every row merges its leftmost pair of minimum rank. Pair ranks come from an open
addressing hash table in numpy arrays; finished rows leave the matrix. Pieces repeat, so results are kept in a table of
bounded size in each Python worker. Very long pieces (which would need as many rounds as they have bytes) merge with a heap.

The ranks are given by the caller (read once from the vocabulary file by its path) and reach the workers as one broadcast
of the vocabulary, about half a megabyte. Nothing is shuffled. Null texts count as empty: no tokens, empty bytes. Rows
repeat as they come; ids may be null; other columns pass through ``encode`` and ``decode`` unless named like the result.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import map_texts, small_batches

#: Pieces of more bytes than this are merged one by one with a heap.
LONG_PIECE = 256
#: Pieces a worker remembers before it starts afresh, and those that it may keep from one task to the next.
MEMORY, KEPT = 400_000, 100_000
NONE = np.int32(2**31 - 1)


class Memory(dict):
    """Numbers pieces in the order of their first appearance; new ones wait to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.waiting.append(piece)
        return number


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.keys = None
        self.forget()

    def forget(self) -> None:
        """Known pieces: the ids of all one after another, where each begins and how many it has."""
        self.memory = Memory()
        self.flat, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _index_pairs(self) -> None:
        """Open addressing table: (left id, right id) to the rank of their concatenation."""
        ranks = self.ranks
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, (4 * len(rank)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = (left << 32) | right
        slot, waiting = self._slot(key), np.arange(len(key))
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]], self.values[slot[placed]] = key[placed], rank[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, NONE where the vocabulary lacks it or a side is padding (-1)."""
        key = (left.astype(np.int64) << 32) | right  # negative where a side is padding: never stored
        slot = self._slot(key)
        held = self.keys[slot]
        hit = held == key
        out = np.where(hit & (key >= 0), self.values[slot], NONE)
        open_ = ~hit & (held >= 0) & (key >= 0)
        at, key, slot = np.nonzero(open_), key[open_], slot[open_]
        while len(key):
            slot = (slot + 1) & (len(self.keys) - 1)
            held = self.keys[slot]
            hit = held == key
            out[tuple(a[hit] for a in at)] = self.values[slot[hit]]
            go = ~hit & (held >= 0)
            at, key, slot = tuple(a[go] for a in at), key[go], slot[go]
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of similar length: a padded matrix, one merge a row and round."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 1), NONE, np.int32)
        while len(rows):
            best = rank.argmin(1)
            low = rank[np.arange(len(rows)), best]
            done = low == NONE
            if done.any():
                ended = ids[done]
                for r, row, n in zip(rows[done].tolist(), ended, (ended >= 0).sum(1).tolist()):
                    out[r] = row[:n]
                go = ~done
                rows, ids, rank, best, low = rows[go], ids[go], rank[go], best[go], low[go]
                if not len(rows):
                    break
            # the pair's left place takes the merged token, everything behind moves up by one
            every, n = np.arange(len(rows)), ids.shape[1]
            source = np.arange(n - 1) + (np.arange(n - 1) > best[:, None])
            ids = np.take_along_axis(ids, source, 1)
            ids[every, best] = low
            if n == 2:
                rank = np.full((len(rows), 1), NONE, np.int32)
                continue
            rank = np.take_along_axis(rank, source[:, : n - 2] if n > 2 else source, 1)
            left = np.maximum(best - 1, 0)
            before = self.pair_ranks(ids[every, left], ids[every, left + 1])
            here = np.minimum(best, n - 3)
            after = self.pair_ranks(ids[every, here], ids[every, here + 1])
            rank[every, here] = after
            rank[every, left] = np.where(best > 0, before, rank[every, left])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Token ids of one long piece; a heap yields the leftmost pair of minimum rank."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(i: int) -> int | None:
            return ranks.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < n else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = r, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self) -> None:
        """Encode the pieces not met before."""
        pieces, self.memory.waiting = self.memory.waiting, []
        if not pieces:
            return
        if self.keys is None:
            self._index_pairs()
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for i, piece in enumerate(data):
            n = len(piece)
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = np.array([rank], np.int32)
            elif n > LONG_PIECE:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault((n + 1) // 2 if n <= 32 else 16 + (n + 31) // 32, []).append(i)
        for bucket in buckets.values():
            for k in range(0, len(bucket), 4096):
                own = bucket[k : k + 4096]
                for i, ids in zip(own, self.merge_rows([data[i] for i in own])):
                    out[i] = ids
        count = np.array([len(x) for x in out], np.int64)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, *out])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memory) > MEMORY:
            self.forget()
        number, cut = self.memory.__getitem__, self.cut
        numbers = [np.fromiter(map(number, cut(t)), np.int64) for t in texts]
        self.learn()
        return [self._joined(x) for x in numbers]

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces one after another."""
        count = self.count[numbers]
        ends = np.cumsum(count)
        if not len(ends):
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(self.begin[numbers] - (ends - count), count) + np.arange(ends[-1])]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        ends = np.cumsum(self.lengths[ids])
        if not len(ids):
            return b""
        spread = np.repeat(self.starts[ids] - np.concatenate([[0], ends[:-1]]), self.lengths[ids])
        return self.bytes[spread + np.arange(ends[-1])].tobytes()


@lru_cache(2)
def _codec(pattern: str, vocabulary: bytes) -> Codec:
    tokens = vocabulary.split()
    return Codec({base64.b64decode(t): i for t, i in zip(tokens[::2], map(int, tokens[1::2]))}, pattern)


def _shared(docs: DataFrame, path: str):
    """The vocabulary file as a broadcast; its size is checked, since it does not grow with the corpus."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the vocabulary is larger than 64 MB")
    return docs.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text; the text itself stays out."""
    shared = _shared(docs, path)
    rest = [F.col(c) for c in docs.columns if c not in (text_col, "ids")]
    rows = docs.select(*rest, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")

    def work(part, texts, codec):
        found = codec.encode(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return [part.column(i) for i in range(part.num_columns - 1)] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    def setup() -> Codec:
        codec = _codec(pattern, shared.value)
        if len(codec.memory) > KEPT:
            codec.forget()
        return codec

    return map_texts(rows, work, (schema + ", " if schema else "") + "ids array<int>", setup)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of its ids; null ids count as none."""
    shared = _shared(tokens, path)
    small_batches(tokens.sparkSession)
    names = [c for c in tokens.columns if c not in (ids_col, "decoded")]
    rows = tokens.select(*names, F.col(ids_col).alias("ids"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructType

    struct = StructType([*rows.schema.fields]).add("decoded", BinaryType())
    arrow = to_arrow_schema(struct)

    def run(batches):
        codec = _codec(pattern, shared.value)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            out = [codec.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, arrow)], pa.array(out, pa.binary())], schema=arrow)

    return rows.mapInArrow(run, struct)
