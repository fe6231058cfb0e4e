"""Scores of texts under a hidden Markov language model trained on the corpus.

A word's probability is that of its class in the hidden state times that of the word in its class. The most common training
words are classes of their own, all others are classed by their endings, so the tables of the chain have a fixed size and
may be sent to all tasks; word counts may not, they grow with the corpus and are joined. Baum-Welch: every task runs the
forward and backward recursion over whole documents and adds up expected counts, Spark sums them over all tasks, the driver
turns the sums (classes x states) into the next tables. The scaled forward recursion then gives the exact likelihood of every
document's class sequence, however long; since a word's share of its class is the same in all states, the sum of those shares
is simply added.

Tokens are lower-cased words and one end. ``HOT_WORDS`` most frequent words of all rows (a table of fixed size) are looked up
in the tasks; every other word goes through a join with the counts, where no word is frequent any more. Sequences of like
lengths are worked on together as matrices in time order.

Defined results: a null text is empty and has its end only; a null id belongs to the training rows; repeated rows count and
are scored one by one; without training rows every count is 0 and the chain is uniform; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import words as W
from ledgerlight.llm.common import map_texts, small_batches, text_runs
from ledgerlight.session import materialise

TABLE = W.kinds(b"\x20\x09\x0a\x0b\x0c\x0d")
STATES = 8
ROUNDS = 4
#: Classes: 0 is the end, then the most common training words, then endings.
OWN_WORDS = 3000
ENDINGS = 1024
CLASSES = 1 + OWN_WORDS + ENDINGS
HOT_WORDS = 100_000
#: Words that a task counts before it passes them on, tokens worked on together, steps between two scalings.
HELD = 400_000
TOKENS = 300_000
SCALED = 16
HELD_OUT = 2


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, c): occurrences in all rows and in training rows."""
    small_batches(docs.sparkSession)
    rows = docs.select("text", held_out().alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush():
            rows = list(held.values())
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000]), (pa.string(), pa.int64(), pa.int64()))], names=["word", "n", "c"])
            held.clear()

        for batch in batches:
            for part, texts in text_runs(batch):
                found = W.words(texts, TABLE)
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)[found.text]
                one, two, data = found.hashed(0), found.hashed(1), found.data.tobytes()
                key, at, back, counts = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
                learnt = np.bincount(back, weights=train, minlength=len(key)).astype(np.int64)
                for x, y, i, n, c in zip(key.tolist(), two[at].tolist(), at.tolist(), counts.tolist(), learnt.tolist()):
                    old = held.get((x, y))
                    if old is None:
                        held[x, y] = [data[found.start[i] : found.end[i]].decode("utf-8", "surrogatepass"), n, c]
                    else:
                        old[1] += n
                        old[2] += c
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


@dataclass(frozen=True)
class Known:
    """Some words by their pair of hashes, with a number each."""

    one: np.ndarray
    two: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, words: list[str], values) -> Known:
        found = W.words(words, TABLE)
        one, two = found.hashed(0), found.hashed(1)
        order = np.argsort(one)
        return cls(one[order], two[order], np.asarray(values)[found.text][order])

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and their numbers (0 elsewhere)."""
        if not len(self.one):
            return np.zeros(len(one), bool), np.zeros(len(one), self.value.dtype)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        hit = (self.one[at] == one) & (self.two[at] == two)
        return hit, np.where(hit, self.value[at], 0)


def classes(found: W.Words, own: Known, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Class of every word: its own, or that of its last three bytes."""
    hit, number = own.find(one, two)
    size = found.end - found.start
    tail = np.minimum(size, 3).astype(np.uint64)
    for k in range(1, 4):
        tail = tail * np.uint64(256) + np.where(size >= k, found.data[np.maximum(found.end - k, 0)], 0).astype(np.uint64)
    return np.where(hit, number, 1 + OWN_WORDS + (W.mix(tail) % np.uint64(ENDINGS)).astype(np.int64)).astype(np.uint16)


def most_frequent(counts: DataFrame, column: str, limit: int) -> list[tuple[str, int]]:
    """(word, c) of the words with the highest ``column``: at most ``limit``, all above one bound.

    The bound is the lowest of a scale of sixteenths of a doubling above which no more words lie, so what reaches the driver
    is bounded, however many partitions the counts have.
    """
    level = F.floor(F.log2(column) * 16)
    held, bound = 0, None
    for r in sorted(counts.where(F.col(column) > 0).groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        held += r["count"]
        if held > limit:
            break
        bound = r.level
    if bound is None:
        return []
    return [(r.word, r.c) for r in counts.where((F.col(column) > 0) & (level >= bound)).select("word", "c").collect()]


def class_totals(counts: DataFrame, own) -> np.ndarray:
    """For each class the training words in it, and how many are distinct; at most CLASSES rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = W.words(batch.column("word").to_pylist(), TABLE)
            own_class = classes(found, own.value, found.hashed(0), found.hashed(1))
            yield pa.RecordBatch.from_arrays([pa.array(own_class.astype(np.int32)), batch.column("c")], names=["cls", "c"])

    found = counts.where("c > 0").select("word", "c").mapInArrow(run, "cls int, c long").groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    totals = np.zeros((CLASSES, 2))
    for r in found.collect():
        totals[r.cls] = r.c, r.v
    return totals


def coded(docs: DataFrame, own, hot, shares) -> DataFrame:
    """One row a document: its classes (the end last), what its hot words add, and its other words with their numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def work(part, texts):
        found = W.words(texts, TABLE)
        one, two, data, n = found.hashed(0), found.hashed(1), found.data.tobytes(), len(texts)
        cls = classes(found, own.value, one, two)
        hit, c = hot.value.find(one, two)
        sums = lambda weights: np.bincount(found.text, weights=weights, minlength=n)
        rare: list[list[dict]] = [[] for _ in texts]
        left = np.flatnonzero(~hit)
        order = left[np.lexsort((one[left], found.text[left]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (found.text[order][1:] != found.text[order][:-1])
        heads = order[fresh]
        times = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        for i, t in zip(heads.tolist(), times.tolist()):
            rare[found.text[i]].append({"word": data[found.start[i] : found.end[i]].decode("utf-8", "surrogatepass"), "times": t})
        codes = [cls[found.first[i] : found.first[i + 1]].tobytes() + b"\0\0" for i in range(n)]
        return [
            part.column("doc_id"), part.column("held_out"), (np.diff(found.first) + 1).astype(np.int64), sums(np.log10(c + 1.0) * hit),
            sums(c > 0).astype(np.int64), sums(shares.value[cls]) + shares.value[0], rare, codes,
        ]

    ddl = "doc_id long, held_out boolean, n_tokens long, logs double, known long, shares double, rare array<struct<word: string, times: long>>, codes binary"
    return map_texts(rows, work, ddl)


@dataclass(frozen=True)
class Chain:
    """Start, transition (from, to) and emission (class, state) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_chain(totals: np.ndarray, seed: int = 13) -> Chain:
    """Sticky states whose emissions are the classes' shares, each shaken apart."""
    rng = np.random.default_rng(seed)
    emit = (totals[:, :1] + 1.0) * np.exp(rng.normal(0.0, 0.5, (CLASSES, STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Chain(np.full(STATES, 1.0 / STATES), move, emit / emit.sum(axis=0))


def groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows, whose last item are codes, in lists of like lengths with about TOKENS tokens, or one long row."""
    held: dict[int, tuple[int, list]] = {}
    for row in rows:
        size = len(row[-1])
        band = min(max(size.bit_length(), 9), 13) // 2
        n, part = held.get(band, (0, []))
        part.append(row)
        held[band] = n + size, part
        if n + size >= TOKENS:
            yield held.pop(band)[1]
    for _, part in held.values():
        yield part


class Sequences:
    """Code sequences laid out in time order: all first tokens, all second tokens, ..., the longest sequence first."""

    def __init__(self, codes: list[np.ndarray]):
        lengths = np.array([len(c) for c in codes])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.offset = np.cumsum(self.active) - self.active
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]
        self.at = self.offset[place] + owner
        self.codes = np.empty(len(owner), np.int64)
        self.codes[self.at] = np.concatenate([codes[i] for i in self.order])
        self.follows = np.flatnonzero(place > 0)
        self.last = self.at[np.cumsum(lengths) - 1]

    def forward(self, chain: Chain, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward values of all tokens, scaled every few steps, and the logarithm of each sequence's likelihood in given order."""
        a, logs = np.empty_like(emitted), np.zeros(len(self.order))
        n = self.active[0]
        np.multiply(chain.start, emitted[:n], out=a[:n])
        before = a[:n]
        for t in range(1, len(self.active)):
            lo, n = self.offset[t], self.active[t]
            now = a[lo : lo + n]
            np.matmul(before[:n], chain.move, out=now)
            now *= emitted[lo : lo + n]
            if t % SCALED == 0:
                s = now.sum(axis=1)
                now /= s[:, None]
                logs[:n] += np.log(s)
            before = now
        logs += np.log(a[self.last].sum(axis=1))
        given = np.empty_like(logs)
        given[self.order] = logs
        return a, given

    def expected(self, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions (class, state), and the log-likelihood."""
        emitted = chain.emit[self.codes]
        a, logs = self.forward(chain, emitted)
        b = np.ones_like(a)
        back = np.ascontiguousarray(chain.move.T)
        later = None
        for t in range(len(self.active) - 1, -1, -1):
            lo, n = self.offset[t], self.active[t]
            now = b[lo : lo + n]
            if later is not None:
                np.matmul(later, back, out=now[: len(later)])
            part = emitted[lo : lo + n]
            part *= now if t % SCALED else now / now.sum(axis=1, keepdims=True)
            later = part
        b *= a
        total = b.sum(axis=1, keepdims=True)
        b /= total
        a /= total
        to, of = self.at[self.follows], self.at[self.follows - 1]
        moves = (a[of].T @ emitted[to]) * chain.move
        seen = np.stack([np.bincount(self.codes, weights=b[:, s], minlength=CLASSES) for s in range(b.shape[1])], axis=1)
        return b[: self.active[0]].sum(axis=0), moves, seen, float(logs.sum())


def _codes(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), (np.frombuffer(c, np.uint16) for c in batch.column("codes").to_pylist()))


def improved(train: DataFrame, chain: Chain) -> tuple[Chain, float]:
    """One round of Baum-Welch over all training rows; CLASSES + STATES + 2 rows of sums reach the driver."""
    names = [f"s{k}" for k in range(STATES)]
    model = train.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES + STATES + 2, STATES))
        for part in groups(_codes(batches)):
            start, moves, seen, logs = Sequences([c for (c,) in part]).expected(model.value)
            sums[:CLASSES] += seen
            sums[CLASSES : CLASSES + STATES] += moves
            sums[-2] += start
            sums[-1, 0] += logs
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(sums[at, k])) for k in range(STATES))], names=["at", *names])

    found = train.select("codes").mapInArrow(run, "at long, " + ", ".join(f"{n} double" for n in names))
    sums = np.zeros((CLASSES + STATES + 2, STATES))
    for r in found.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect():
        sums[r["at"]] = r[1:]
    model.unpersist()
    # a little of everything stays possible, so that no unseen class has probability 0
    emit, move, start = sums[:CLASSES] + 0.05, sums[CLASSES : CLASSES + STATES] + 0.5, sums[-2] + 0.5
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), sums[-1, 0]


def likelihoods(saved: DataFrame, chain: Chain) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, logs, known, shares, path): ``path`` is log10 of the class sequence's likelihood."""
    columns = ("row", "doc_id", "held_out", "n_tokens", "logs", "known", "shares")
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
    model = saved.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(_codes(batches, *columns)):
            found = Sequences([r[-1] for r in part])
            _, logs = found.forward(model.value, model.value.emit[found.codes])
            rows = zip(*(r[:-1] for r in part))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, types)), pa.array(logs / np.log(10.0))], names=[*columns, "path"])

    return saved.select(*columns, "codes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, logs double, known long, shares double, path double")


def score_texts(docs: DataFrame, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    context = docs.sparkSession.sparkContext
    counts = materialise(word_counts(docs))
    ends = docs.where(~held_out()).count()
    whole = counts.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, distinct = int(whole.c or 0) + ends, int(whole.v) + (ends > 0)

    common = sorted(most_frequent(counts, "c", OWN_WORDS))
    own = context.broadcast(Known.of([w for w, _ in common], np.arange(1, len(common) + 1)))
    totals = class_totals(counts, own)
    totals[0] = ends, ends > 0
    frequent = most_frequent(counts, "n", hot_words)
    hot = context.broadcast(Known.of([w for w, _ in frequent], np.array([c for _, c in frequent], np.int64)))
    saved = materialise(coded(docs, own, hot, context.broadcast(-np.log10(totals.sum(axis=1) + 1.0))))

    chain = first_chain(totals)
    train = saved.where("NOT held_out")
    for _ in range(rounds if ends else 0):
        chain, _ = improved(train, chain)
    numbered = saved.withColumn("row", F.monotonically_increasing_id())
    others = numbered.select("row", F.inline("rare")).join(counts.select("word", "c"), "word")
    added = others.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    rows = likelihoods(numbered, chain).join(added, "row", "left")
    end = float(np.log10(ends + 1.0))
    words = F.col("logs") + F.coalesce("more", F.lit(0.0)) + F.lit(end)
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * F.lit(float(np.log10(n_train + distinct + 1.0)))).alias("base_score"), (F.col("path") + words + F.col("shares")).alias("score"),
    )
