"""Near duplicates of a given similarity: SimHash links, checked by the whole shingle sets, and an exact prefix join for the rest.

Every shingle set has a 64-bit SimHash. Sets whose fingerprints differ in at most ``simhash.MAX_BITS`` bits are linked by the
look-up of ``simhash.links`` and stay linked where the sets are as similar as asked. Few bits find close copies only, so the
components found are completed by a join that no pair escapes.

All shingles have one order for the whole corpus. Two sets of Jaccard similarity ``similarity`` share one of the first
n - ceil(similarity * n) + 1 shingles of each (their prefixes), so documents meet in the shingles of their prefixes, and no pair
is lost, however few shingles the texts have. Candidates are pruned only by what no pair as similar as asked can break: the
ratio of the sizes, the places of each shared shingle (those on both sides of it must be enough), and the number of shared
shingles of the prefixes (with those after the prefixes it must be enough). Then the whole sets are compared.

Any order is right; here the order is by hash, with shingles of well-filled buckets (common lines and passages) last, so that
they are in hardly any prefix. The buckets are counted by hash in a table of fixed size. Of the prefixes, only shingles that
several prefixes hold are joined; a bit array of fixed size (FILTER_BITS) tells which those may be, and when a corpus fills it,
it lets more shingles pass but loses none.

A shingle that CROWD_ROWS or more prefixes hold is crowded (a second bit array of fixed size tells which ones may be). Documents
that meet there carry a sketch of their whole set, SKETCH_BITS parities: two sketches differ in no more bits than the sets in
shingles, so a pair too far apart is dropped before it leaves the task, and no other. They also carry their crowded shingles: a
pair leaves a task once, where its smallest one is, with the number of all that it shares.

Equal shingle sets are one node. Before pairs are made, documents of one of STAR_CELLS bands of three minima that STAR_ROWS or
more share are linked to the smallest of them where they are as similar as asked (one candidate a document and band), and other
pairs are made between different components only, so a large group of near copies does not cost the square of its size.

Nulls, empty texts, repeated rows and other columns are treated as in ``simhash``; texts of fewer than ``shingle`` words are
one shingle.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm import simhash
from ledgerlight.llm.common import map_texts, small_batches, text_runs
from ledgerlight.llm.components import connected_components
from ledgerlight.session import materialise

SHINGLE, SIMILARITY = 5, 0.8
#: Documents with a band of minima in common from which on they are linked to the smallest of them first.
STAR_ROWS, STAR_CELLS = 32, 4
MIX = np.random.default_rng(7).integers(0, 1 << 63, 3 * STAR_CELLS, np.uint64) * np.uint64(2) + np.uint64(1)
FILTER_BITS = 26
#: Buckets that shingles are counted in; one is well filled with HOT_SHARE times the mean and HOT_ROWS more.
BUCKET_BITS, HOT_SHARE, HOT_ROWS = 22, 4, 32
#: Prefixes that hold a shingle from which on it is crowded, and bits of the sketches that are compared there.
CROWD_ROWS, SKETCH_BITS = 32, 512
#: Bytes of the prefix join's rows that are held at a time, and pairs (or crowded cells of pairs) that are made at a time.
HELD_BYTES, HELD_PAIRS = 8 << 20, 250_000


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    last = max(1, len(words) - size + 1)
    of = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((of(joined[s:e]) for s, e in zip(starts[:last], ends[min(size, len(words)) - 1 :].tolist())), np.uint64, last))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a shingle set as signed 64-bit integer: a bit is 1 if set in over half the hashes (no shingles: zero)."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        bits += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _hot_buckets(rows: DataFrame, shingle: int) -> np.ndarray:
    """Which buckets hold far more shingles than others; at most a share 1 / HOT_SHARE of them reaches the driver.

    A task reports buckets well filled among its own documents. The order of shingles depends on this, the result does not.
    """
    small_batches(rows.sparkSession)

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for _, texts in text_runs(batch):
                for t in texts:
                    np.add.at(total, _bucket(shingle_set(t, shingle)), 1)
        index = np.flatnonzero(total > HOT_SHARE * total.mean() + 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[index, -1], pa.int64()), pa.array(np.r_[total[index], total.sum(dtype=np.int64)], pa.int64())], names=["bucket", "n"])

    # saved, so that texts are read once for both of its readers
    sums = materialise(rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = (sums.where("bucket = -1").agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS)
    found = sums.where((F.col("bucket") >= 0) & (F.col("n") > HOT_SHARE * mean + HOT_ROWS)).select("bucket").toPandas()
    hot = np.zeros(1 << BUCKET_BITS, bool)
    hot[found["bucket"].to_numpy(np.int64)] = True
    return hot


def prefix_size(n, similarity: float):
    return n - np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64) + 1


def prefix(hashes: np.ndarray, hot: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of the corpus (well-filled buckets last, then by hash)."""
    if not len(hashes):
        return hashes
    late = hot[_bucket(hashes)]
    return np.concatenate([hashes[~late], hashes[late]])[: int(prefix_size(len(hashes), similarity))]


def bands(hashes: np.ndarray) -> np.ndarray:
    """STAR_CELLS values that very similar sets are likely to share, each of the minima of three orders."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.array([(hashes * m).min() for m in MIX]).reshape(STAR_CELLS, 3)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least)], np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH_BITS parities of a shingle set; the sketches of two sets differ in at most as many bits as the sets in shingles."""
    return np.packbits(np.bincount((hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _bits(cells: DataFrame, *flags: Column) -> np.ndarray:
    """A bit array of fixed size for each of ``flags``, one after the other: the cells of ``cells`` (cell) where it holds."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(cell, {64 - FILTER_BITS}) & 63 AS int))")
    words = cells.groupBy(F.shiftrightunsigned("cell", 64 - FILTER_BITS + 6).alias("word")).agg(*[F.bit_or(F.when(f, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k, f in enumerate(flags)])
    found = words.toPandas()
    bits = np.zeros((len(flags), 1 << (FILTER_BITS - 6)), np.uint64)
    for k in range(len(flags)):
        bits[k, found["word"].to_numpy(np.int64)] = found[f"bits{k}"].to_numpy(np.int64).view(np.uint64)
    return bits.ravel()


def _shared(cells: DataFrame) -> np.ndarray:
    """Bit array over the cells that more than one row of ``cells`` (cell) holds, and after it one over the crowded cells."""
    return _bits(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), F.lit(True), F.col("n") >= CROWD_ROWS)


def _held(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Places of the cells whose bits are set."""
    bit = cells >> np.uint64(64 - FILTER_BITS)
    return np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))


class Crowds:
    """All crowded cells of each row, one flat sorted array of (row, number of the cell): no Python object a cell."""

    def __init__(self, lists: pa.ListArray):
        self.cells, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        self.lengths = lists.value_lengths().to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.keys = np.repeat(np.arange(len(lists)), self.lengths) * len(self.cells) + code
        self.keys.sort()

    def shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many cells the rows ``a`` and ``b`` of each pair share, and the smallest of these; every pair shares one."""
        shorter = self.lengths[a] <= self.lengths[b]
        a, b = np.where(shorter, a, b), np.where(shorter, b, a)
        many = np.cumsum(self.lengths[a])
        n, least = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        k = 0
        while k < len(a):
            to = max(k + 1, int(np.searchsorted(many, (many[k - 1] if k else 0) + HELD_PAIRS, "right")))
            x, y, size = a[k:to], b[k:to], self.lengths[a[k:to]]
            at = np.arange(size.sum()) + np.repeat(self.ends[x] - np.cumsum(size), size)
            sought = self.keys[at] + np.repeat((y - x) * len(self.cells), size)
            found = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)] == sought)
            pair = np.repeat(np.arange(to - k), size)[found]
            first = found[np.r_[True, pair[1:] != pair[:-1]]]
            n[k:to] = np.bincount(pair, minlength=to - k)
            least[k:to] = self.cells[self.keys[at[first]] - x * len(self.cells)]
            k = to
        return n, least


def candidates(cell: np.ndarray, place: np.ndarray, size: np.ndarray, node: np.ndarray, component: np.ndarray, similarity: float, sketches: np.ndarray | None = None, crowds: list | pa.ListArray | None = None):
    """Pairs of nodes of different components with one cell, as far as sizes and places let them be similar; in parts.

    A part holds (a, b, n, need): how many cells a pair shares here, and how many it must share in all. With ``sketches`` and
    ``crowds`` (all crowded cells of each row's node, as lists or an Arrow list array) pairs whose sketches are too far apart are
    left out, and the others come at the smallest crowded cell that they share, n being the number of these.
    """
    order = np.lexsort((size, cell))
    cell, place, size, node, component = (x[order] for x in (cell, place, size, node, component))
    if crowds is not None:
        sketches, crowds = sketches[order], Crowds(crowds if isinstance(crowds, pa.Array) else pa.array(map(list, crowds), pa.list_(pa.int64())))
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    stop = np.repeat(np.r_[start[1:], len(cell)], np.diff(np.r_[start, len(cell)]))
    # partners of a row are after it, up to the size that is still similar
    last = np.arange(len(cell))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(cell)]):
        if b - a > 1 and (component[a:b] != component[a]).any():
            last[a:b] = a + np.searchsorted(size[a:b] * similarity, size[a:b] + 1e-6, "right") - 1
    many = np.minimum(last, stop - 1) - np.arange(len(cell))
    done = np.r_[0, np.cumsum(many)]
    k = 0
    while k < len(cell):
        to = max(k + 1, int(np.searchsorted(done, done[k] + HELD_PAIRS, "right")) - 1)
        i = np.repeat(np.arange(k, to), many[k:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(done[k:to] - done[k], many[k:to])
        common = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])
        asked = np.ceil(similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6).astype(np.int64)
        good = (component[i] != component[j]) & (common >= asked)
        i, j, asked = i[good], j[good], asked[good]
        n = np.ones(len(i), np.int64)
        if crowds is not None:
            apart = np.zeros(len(i), np.int64)
            for w in range(sketches.shape[1]):
                apart += np.bitwise_count(sketches[i, w] ^ sketches[j, w])
            near = apart <= size[i] + size[j] - 2 * asked
            i, j, asked = i[near], j[near], asked[near]
            n, least = crowds.shared(order[i], order[j])
            here = least == cell[i]
            i, j, asked, n = i[here], j[here], asked[here], n[here]
        if len(i):
            need = np.maximum(1, asked - np.maximum(size[i] - prefix_size(size[i], similarity), size[j] - prefix_size(size[j], similarity)))
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            by = np.lexsort((b, a))
            a, b, need, n = a[by], b[by], need[by], n[by]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield a[first], b[first], np.add.reduceat(n, first), need[first]
        k = to


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that connect all fingerprints at ``simhash.MAX_BITS`` or fewer differing bits.

    The nodes of one fingerprint link to the smallest of them, and these to each other, so the pairs grow with the nodes.
    """
    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(fps, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    near = simhash.links(fps.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.union(near)


def near_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, component_id) of every row; component_id is the smallest id reachable over pairs as similar as asked."""
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, F.xxhash64("doc_id", key).alias("row"), "text")
    hot = docs.sparkSession.sparkContext.broadcast(_hot_buckets(rows, shingle))

    def name(x: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)

    def own(part, texts):
        sets = [shingle_set(t, shingle) for t in texts]
        return [*[part.column(c) for c in ("doc_id", "text_key", "row")], list(map(name, sets)), list(map(len, sets)), list(map(fingerprint, sets)), list(map(bands, sets))]

    found = materialise(map_texts(rows, own, "doc_id long, text_key long, row long, own long, size int, fp long, bands array<long>"))
    nodes = materialise(found.groupBy("own").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("size", "fp", "bands")]))

    def cells(part, texts):
        return [np.concatenate([prefix(shingle_set(t, shingle), hot.value, similarity) for t in texts]).view(np.int64)]

    bits = docs.sparkSession.sparkContext.broadcast(_shared(map_texts(rows.select("text"), cells, "cell long")))

    def shared_cells(part, texts):
        ids, places, kept, crowds, sketches = [], [], [], [], []
        words = 1 << (FILTER_BITS - 6)
        for row, t in zip(part.column("row").to_pylist(), texts):
            whole = shingle_set(t, shingle)
            x = prefix(whole, hot.value, similarity)
            place = _held(bits.value[:words], x)
            x = x[place]
            crowd = x[_held(bits.value[words:], x)]
            ids.append(row)
            places.append(place.astype(np.int32))
            kept.append(x.view(np.int64))
            crowds.append(crowd.view(np.int64))
            sketches.append(sketch(whole) if len(crowd) else None)
        return [ids, places, kept, crowds, sketches]

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are near by their shingles."""
        near = materialise(pairs.distinct())
        asked = near.select(F.col("a").alias("cell")).union(near.select("b")).distinct()
        wanted = docs.sparkSession.sparkContext.broadcast(_bits(asked, F.lit(True)))

        def sets_of(part, texts):
            take = _held(wanted.value, part.column("row").to_numpy().view(np.uint64))
            return [part.column("row").take(pa.array(take)), [shingle_set(texts[k], shingle).tobytes() for k in take.tolist()]]

        # texts stay where they are: only the sets of rows that may be asked for are shuffled
        sets = materialise(map_texts(rows.select("row", "text"), sets_of, "row long, hashes binary").dropDuplicates(["row"]))
        both = near.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("hb")), "b")

        def compare(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("ha"), batch.column("hb")):
                    x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common >= similarity * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return both.select("a", "b", "ha", "hb").mapInArrow(compare, "a long, b long")

    # close copies by fingerprint, and documents of well-filled bands, each linked to the smallest one of them that is as similar as asked
    table = nodes.select("node", "size", F.explode("bands").alias("cell"))
    least = table.groupBy("cell").agg(F.min(F.struct("node", "size")).alias("to"), F.count("*").alias("n")).where(F.col("n") >= STAR_ROWS).select("cell", "to")
    star = table.join(least, "cell").where(f"node <> to.node AND least(size, to.size) + 1e-6 >= {similarity} * greatest(size, to.size)")
    starred = materialise(verified(star.select(F.col("node").alias("a"), F.col("to.node").alias("b")).union(fingerprint_links(nodes))))
    groups = connected_components(starred)
    known = nodes.join(groups.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"), "size")
    met = map_texts(rows.select("row", "text"), shared_cells, "row long, places array<int>, cells array<long>, crowd array<long>, sketch binary").where("size(cells) > 0")
    met = met.dropDuplicates(["row"]).join(known, F.col("row") == F.col("node"))
    entries = met.select("node", "component", "size", "crowd", "sketch", F.inline(F.arrays_zip("places", "cells"))).withColumnsRenamed({"places": "place", "cells": "cell"})
    crowded = lambda c: F.when(F.array_contains("crowd", F.col("cell")), F.col(c)).alias(c)
    entries = entries.select("cell", "place", "size", "node", "component", crowded("crowd"), crowded("sketch"))
    entries = entries.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1").drop("n")

    def meet(batches):
        held, size, limit = [], 0, HELD_BYTES

        def made(table):
            alone = table.filter(table["sketch"].is_null())
            together = table.filter(table["sketch"].is_valid())
            numbers = lambda x: [x[c].to_numpy().astype(np.int64) for c in ("cell", "place", "size", "node", "component")]
            sketches = np.frombuffer(b"".join(together["sketch"].to_pylist()), np.uint64).reshape(len(together), SKETCH_BITS // 64)
            for part in chain(candidates(*numbers(alone), similarity), candidates(*numbers(together), similarity, sketches, together["crowd"].combine_chunks())):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=["a", "b", "n", "need"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= limit:
                table = pa.Table.from_batches(held)
                cells = table["cell"].to_numpy()
                # rows of the last cell wait for the rest of it
                cut = len(cells) - int((cells[::-1] != cells[-1]).argmax()) if cells[0] != cells[-1] else 0
                yield from made(table.slice(0, cut))
                table = table.slice(cut)
                held, size = table.to_batches(), table.nbytes
                limit = max(HELD_BYTES, 2 * size)
        if held:
            yield from made(pa.Table.from_batches(held))

    counted = entries.mapInArrow(meet, "a long, b long, n long, need long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    parts = connected_components(starred.union(verified(counted.where("n >= need").select("a", "b"))))
    owned = nodes.join(parts.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left").select("own", "low", F.coalesce("component", "node").alias("component"))
    ids = owned.groupBy("component").agg(F.min("low").alias("component_id"))
    return found.join(owned.select("own", "component"), "own").join(ids, "component").select("doc_id", "text_key", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Rows without an id go only where a document with an id stands for them.
    """
    found = near_documents(docs, **options).where("NOT doc_id <=> component_id")
    lost = materialise(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    return docs.join(lost, F.expr("doc_id <=> _id AND xxhash64(coalesce(text, '')) = _key"), "left_anti")
