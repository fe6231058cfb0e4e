"""Phrase collocations by partitioning (SON): shards are mined with a lowered support, then all candidates are counted exactly.

The input's partitions are dealt into a few shards. A phrase that reaches the support in a language reaches, in one shard at least, its
share of it, the shard's part of the language's words. So every shard is mined completely at that share, level by level: a
phrase is counted in a shard only if both phrases one word shorter are locally frequent somewhere. The union of what shards
find are the candidates; a second reading of the texts counts every candidate exactly by its text.

A shard is a column, not a task: tasks combine hashed phrases of what they read and Spark adds them up by (phrase, shard), so
a shard may be as large as it likes. The hashes only choose candidates, a collision can add one but never lose one. Candidates
reach tasks as a table of bits of fixed size; where it fills up, more phrases are counted, none is lost. Common phrases are
summed before each shuffle; the lookup of their counts deals those of the most common parts apart (at most HOT_SHARE a
language). Every document of a language may be in it: no language, shard or phrase is in one task.

Defined results: a null language is ``und``, a null text empty; repeated rows count again; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm import words as W
from ledgerlight.llm.common import map_texts, small_batches
from ledgerlight.session import materialise

TABLE = W.kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Shards of the corpus, groups of input partitions; a power of two up to 256. Fewer shards have a higher support, so fewer candidates.
SHARDS = 4
#: Bits of a phrase's hash while it may be a candidate. Few phrases are frequent, so few of the others share a slot with one
#: of them, whatever the size of the corpus.
KEY = (1 << 40) - 1
#: Bits of the table of candidates that all tasks hold (16 MB).
BITS = 1 << 27
SLICE = 1 << 16
#: Phrases that a task gathers before it combines them.
HELD = 6_000_000
#: Distinct phrases with their texts that a task holds while it counts.
HELD_TEXTS = 400_000
#: Words of the corpus for each bucket that adds up exact counts, and for each that adds up hashes.
BUCKET_WORDS, MINED_WORDS = 1_000_000, 10_000_000
#: A part of phrases is common if it makes up more than one in so many of its language's words.
HOT_SHARE = 1000
#: Rows up to which a table of languages is sent to all tasks; a larger one is joined by a shuffle.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A saved table of one row a language (or language and shard), to be sent to all tasks if it is small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def coded(docs: DataFrame) -> DataFrame:
    """(lang, seed, shard, n, codes): words as 32-bit codes, 0 before each piece, joined for a run's documents of one language and shard."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard"), "text"
    ).withColumn("seed", F.xxhash64("lang"))

    def work(part, texts):
        found = W.words(texts, TABLE)
        codes = (found.hashed() >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        fresh = np.diff(found.piece, prepend=-1) != 0
        groups: dict[tuple, list[np.ndarray]] = {}
        keys = list(zip(part.column("lang").to_pylist(), part.column("seed").to_pylist(), part.column("shard").to_pylist()))
        for i, key in enumerate(keys):
            lo, hi = found.first[i], found.first[i + 1]
            if hi > lo:
                new = fresh[lo:hi]
                line = np.zeros(hi - lo + int(new.sum()), np.uint32)
                line[np.arange(hi - lo) + np.cumsum(new)] = codes[lo:hi]
                groups.setdefault(key, []).append(line)
        joined = {k: np.concatenate(v) for k, v in groups.items()}
        head = list(zip(*joined)) or [(), (), ()]
        return [*map(list, head), [int(np.count_nonzero(v)) for v in joined.values()], [v.tobytes() for v in joined.values()]]

    return map_texts(rows, work, "lang string, seed long, shard long, n long, codes binary")


def grams(codes: np.ndarray, seed: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to ``longest``: hashes of the phrases from every place on, and where they lie within one piece."""
    word = codes.astype(np.uint64)
    g, ok = W.mix(word ^ np.uint64(seed & (2**64 - 1))), codes != 0
    yield g, ok
    for k in range(1, longest):
        g = W.mix(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
        ok = ok[:-1] & (codes[k:] != 0)
        yield g, ok


def has(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    at = (g >> np.uint64(8)) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def local_counts(saved: DataFrame, length: int, table, min_count: int, buckets: int) -> DataFrame:
    """(key): phrases of one length that are frequent in some shard, by their hash.

    Tasks send packs, one a bucket of hashes, shard and support: the sorted rest of each hash in four bytes and its count. A
    bucket holds all shards, so the sum over the shards is at hand as well: a phrase that does not reach the support there is
    left out, since the sum of a hash is never below the phrase's own. There are as many buckets as MINED_WORDS fit into the
    corpus, which bounds what meets in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value if table is not None else None
        held: dict[tuple, list[np.ndarray]] = {}

        def flush():
            for (shard, least), parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                bucket = keys % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                rest, counts = (keys[order] // np.uint64(buckets)).astype(np.uint32), np.minimum(counts[order], 2**32 - 1).astype(np.uint32)
                own, first = np.unique(bucket[order], return_index=True)
                ends = np.append(first[1:], len(order))
                small = [bool((counts[i:j] < 256).all()) for i, j in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own.astype(np.int64)), pa.array(np.full(len(own), shard, np.int64)), pa.array(np.full(len(own), least, np.int64)),
                    pa.array([rest[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()),
                    pa.array([counts[i:j].astype(np.uint8 if s else np.uint32).tobytes() for i, j, s in zip(first, ends, small)], pa.binary()),
                ], names=["bucket", "shard", "least", "rest", "counts"])
            held.clear()

        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], np.uint32)
                before = None
                for k, (g, ok) in enumerate(grams(codes, r["seed"], length), 1):
                    if k < length - 1:
                        continue
                    if k == length - 1:
                        before = ok & has(bits, g)
                        if not before.any():
                            break
                        continue
                    at = ok if before is None else ok & before[:-1] & before[1:]
                    held.setdefault((r["shard"], r["least"]), []).append(g[at] & np.uint64(KEY))
                    size += int(np.count_nonzero(at))
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    def added(key: tuple, packs: pa.Table) -> pa.Table:
        rows = packs.to_pylist()
        rest = [np.frombuffer(r["rest"], np.uint32) for r in rows]
        counts = [np.frombuffer(r["counts"], np.uint8 if len(r["counts"]) == len(x) else np.uint32) for r, x in zip(rows, rest)]
        sizes = [len(x) for x in rest]
        # a phrase, then its shard; one shard and language have one support
        whole = np.concatenate(rest).astype(np.uint64) * np.uint64(SHARDS) + np.repeat([r["shard"] for r in rows], sizes).astype(np.uint64)
        order = np.argsort(whole)
        whole, n, least = whole[order], np.concatenate(counts).astype(np.int64)[order], np.repeat([r["least"] for r in rows], sizes)[order]
        first = np.flatnonzero(np.diff(whole, prepend=whole[:1] + np.uint64(1)))
        local, least = np.add.reduceat(n, first), np.maximum.reduceat(least, first)
        phrase = whole[first] // np.uint64(SHARDS)
        first = np.flatnonzero(np.diff(phrase, prepend=phrase[:1] + np.uint64(1)))
        good = np.logical_or.reduceat(local >= least, first) & (np.add.reduceat(local, first) >= min_count)
        return pa.table({"key": pa.array((phrase[first][good] * np.uint64(buckets) + np.uint64(key[0].as_py())).astype(np.int64))})

    found = saved.select("seed", "shard", "least", "codes").mapInArrow(run, "bucket long, shard long, least long, rest binary, counts binary")
    return found.groupBy("bucket").applyInArrow(added, "key long")


def marked(found: DataFrame, bits: np.ndarray) -> None:
    """Set the bits of the phrases found; what reaches the driver is at most the table itself, in slices."""
    width = SLICE
    at = F.shiftright("key", 8).bitwiseAND(F.lit(8 * len(bits) - 1))
    slices = found.select(F.floor(at / width).alias("slice"), (at % width).cast("int").alias("bit")).groupBy("slice").agg(F.collect_set("bit").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in batch.column("at"):
                line = np.zeros(width, np.uint8)
                line[at.values.to_numpy()] = 1
                rows.append(np.packbits(line, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(rows, pa.binary())], names=["slice", "bits"])

    for r in slices.mapInArrow(run, "slice long, bits binary").toLocalIterator():
        part = slice(r.slice * width // 8, (r.slice + 1) * width // 8)
        bits[part] |= np.frombuffer(r.bits, np.uint8)


def candidates(saved: DataFrame, longest: int, min_count: int, buckets: int):
    """Table of bits (broadcast) of all phrases that are frequent in some shard."""
    context = saved.sparkSession.sparkContext
    bits, table = np.zeros(BITS // 8, np.uint8), None
    for length in range(1, longest + 1):
        found = local_counts(saved, length, table, min_count, buckets)
        marked(found, bits)
        table = context.broadcast(bits)
    return table


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair of hashes, and how often it occurs."""
    _, at, back, counts = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
    if (second[at][back] != second).any():
        pairs = np.stack([first, second], axis=1)
        _, at, counts = np.unique(pairs, axis=0, return_index=True, return_counts=True)
    return at, counts


def exact_counts(docs: DataFrame, table, longest: int, min_count: int, buckets: int) -> DataFrame:
    """(lang, phrase, words, f): exact counts, from ``min_count``, of all candidates, one-word phrases included.

    What a task has counted goes out in packs, one a bucket and language, sorted so that they compress well; a bucket's packs
    are added up by text in one task. There are as many buckets as BUCKET_WORDS fit into the corpus, so what meets in one is
    bounded by the words of one.
    """
    from ledgerlight.llm.common import text_runs

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").withColumn("seed", F.xxhash64("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = table.value, {}

        def flush():
            packs: dict[tuple, list] = {}
            for (x, _), (lang, phrase, c) in held.items():
                packs.setdefault((x % buckets, lang), []).append((phrase, c))
            held.clear()
            for (bucket, lang), pack in packs.items():
                own, counts = zip(*sorted(pack))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket]), pa.array([lang]), pa.array([own], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["bucket", "lang", "phrases", "counts"]
                )

        for batch in batches:
            for part, texts in text_runs(batch):
                found = W.words(texts, TABLE)
                one, two = found.hashed(0), found.hashed(1)
                codes = (one >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                langs, seeds = part.column("lang").to_pylist(), part.column("seed").to_numpy().view(np.uint64)
                seed, word = seeds[found.text], codes.astype(np.uint64)
                g = h1 = h2 = None
                data = found.data.tobytes()
                for k in range(1, longest + 1):
                    m = len(codes) - k + 1
                    if m <= 0:
                        break
                    if k == 1:
                        g, h1, h2 = W.mix(word ^ seed), one ^ seed, two ^ seed
                    else:
                        g = W.mix(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k - 1 :])
                        h1 = W.mix(h1[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[k - 1 :])
                        h2 = W.mix(h2[:-1] * np.uint64(0xD1342543DE82EF95) + two[k - 1 :])
                    at = np.flatnonzero((found.piece[: m] == found.piece[k - 1 :]) & has(bits, g))
                    if not len(at):
                        continue
                    places, counts = _distinct(h1[at], h2[at])
                    at = at[places]
                    for i, x, y, c in zip(at.tolist(), h1[at].tolist(), h2[at].tolist(), counts.tolist()):
                        old = held.get((x, y))
                        if old is None:
                            phrase = b" ".join([data[found.start[j] : found.end[j]] for j in range(i, i + k)]).decode("utf-8", "surrogatepass")
                            held[x, y] = [langs[found.text[i]], phrase, c]
                        else:
                            old[2] += c
                if len(held) > HELD_TEXTS:
                    yield from flush()
        yield from flush()

    def added(key: tuple, packs: pa.Table) -> pa.Table:
        flat = pa.table({"phrase": pc.list_flatten(packs["phrases"]), "f": pc.list_flatten(packs["counts"])})
        sums = flat.group_by("phrase").aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums["f_sum"], min_count))
        return pa.table({"lang": pa.array([key[1].as_py()] * len(sums), pa.string()), "phrase": sums["phrase"], "f": sums["f_sum"]})

    found = rows.mapInArrow(run, "bucket long, lang string, phrases array<string>, counts array<long>")
    counts = found.groupBy("bucket", "lang").applyInArrow(added, "lang string, phrase string, f long")
    return counts.withColumn("words", F.size(F.split("phrase", " ")))


def with_count(rows: DataFrame, part: str, name: str, counts: DataFrame, hot: DataFrame) -> DataFrame:
    """Add the count of a part that is known to be in ``counts``; common parts (a bounded number) never meet in a shuffle."""
    keyed = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name), "hot")
    on = ["lang", part]
    few = keyed.where("hot").drop("hot")
    cold = rows.join(F.broadcast(hot.select("lang", F.col("phrase").alias(part))), on, "left_anti").join(keyed.where("NOT hot").drop("hot"), on)
    return rows.join(F.broadcast(few), on).select(*rows.columns, name).unionByName(cold.select(*rows.columns, name))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in exact decimals of 38 digits: counts below 10^17 fit."""
    whole = lambda c: c.cast("decimal(18,0)")
    up = (whole(a) * whole(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", up, (whole(left) * whole(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language, each by its weakest cut."""
    saved = materialise(coded(docs))
    shard_words = saved.groupBy("lang", "shard").agg(F.sum("n").alias("part"))
    total = Window.partitionBy("lang")
    share = materialise(shard_words.withColumn("n", F.sum("part").over(total)))
    # the support's share, rounded up in whole numbers
    least = F.expr(f"({min_count} * CAST(part AS DECIMAL(20,0)) + n - 1) div n")
    mined = saved.join(small(share.select("lang", "shard", least.alias("least"))), ["lang", "shard"]).select("seed", "shard", "least", "codes")
    words = int(saved.agg(F.sum("n")).first()[0] or 0)
    # hashes keep four bytes of their own beside the bucket
    table = candidates(mined, longest, min_count, max(256, words // MINED_WORDS))
    totals = share.select("lang", "n").distinct()
    counts = exact_counts(docs, table, longest, min_count, max(64, words // BUCKET_WORDS))
    counts = materialise(counts.join(small(totals), "lang").withColumn("hot", F.col("f") * HOT_SHARE >= F.col("n")))
    hot = counts.where("hot")

    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), "n")
    split = found.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    split = split.select(
        "lang", "phrase", "words", "a", "n", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("tail"),
    )
    cuts = with_count(with_count(split, "head", "l", counts, hot), "tail", "r", counts, hot)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " ")),
    ))
    longer = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 100))
    rows = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    # the best of parts of a language first, so that no language is sorted in one task
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
