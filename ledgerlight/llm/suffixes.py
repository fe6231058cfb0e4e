"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes of a text (at word starts) those at minimiser positions are kept: in every window of WINDOW runs of GRAM
words the run with the smallest hash. Any MIN_WORDS words that two documents share hold the same minimiser in both. The
kept suffixes of the corpus are sorted, neighbours of different documents are compared, and each match is extended left and
right; where both sides together reach MIN_WORDS words, the passage is reported. Long passages hold many minimisers, whose
spans are joined, so the context that a suffix carries (REACH words each way) is enough for a passage of any length.

Only suffixes whose first GRAM words occur in two documents can match. A bit array of fixed size (FILTER_BITS) tells which
those may be; it is built by Spark and broadcast, and when a corpus fills it, it lets more suffixes pass but loses none.
Equal contexts are combined, in the map-side part of an aggregation, before anything is sorted, so a passage with many
copies is one row there. The sorted rows are dealt by ranges of the whole context, so a frequent first run of words is
spread; each range knows the last row before and the first after it. Where one first run lies in several ranges, every window of
MIN_WORDS words around its suffixes counts, so that no match depends on the borders of ranges. Equal windows lie in one range
unless their words after the run reach over its border; those that do are sorted anew by the words before the run, and only
windows that reach over a border both times (a few values a border, however many rows have them) are grouped across ranges.

Words are what ASCII white space separates. Contexts are compared by 16-bit codes of the words, first runs by 64-bit hashes:
a chance match of a word beside a passage (1 in 65,536) makes it one word longer. Inside a periodic stretch only every
STRIDE-th suffix of a run is kept. A document is an id with a text: rows that repeat both are one document, a null id is an
id of its own; null texts are empty. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import map_texts
from ledgerlight.session import materialise

MIN_WORDS = 50
GRAM = 8
WINDOW = MIN_WORDS - GRAM + 1
#: Words of context before a kept suffix and after its first GRAM words: every window of MIN_WORDS has a minimiser that near.
REACH = MIN_WORDS - GRAM
STRIDE = 32
FILTER_BITS = 26
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes of a text and the hashes of their first GRAM words."""
    if len(h) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for j in range(GRAM):
        g = g * MIX + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    # in blocks, so that the windows of a very long text take little memory
    place = np.unique(np.concatenate([
        k + np.lib.stride_tricks.sliding_window_view(g[k : k + 65_536 + WINDOW - 1], WINDOW).argmin(1) + np.arange(min(65_536, n - WINDOW + 1 - k))
        for k in range(0, n - WINDOW + 1, 65_536)
    ]))
    first = np.ones(len(place), bool)
    first[1:] = (g[place[1:]] != g[place[:-1]]) | (np.diff(place) > WINDOW)
    step = (place - place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]) // STRIDE
    keep = first.copy()
    keep[1:] |= step[1:] != step[:-1]
    place = place[keep]
    return place, g[place]


def _rows(docs: DataFrame) -> DataFrame:
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", key).alias("row"), "text")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _repeated(rows: DataFrame) -> np.ndarray:
    """Bit array over hashes of first runs that several documents hold."""

    def work(part, texts):
        found = [anchors(word_hashes(t))[1] for t in texts]
        # once for each document
        own = [np.unique(x) for x in found]
        spread = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return [_signed(np.concatenate(own)), part.column("row").take(pa.array(spread))]

    grams = map_texts(rows.select("row", "text"), work, "gram long, row long")
    shared = grams.groupBy("gram").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high")
    bit = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    word = shared.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FILTER_BITS}) & 63 AS int)))").alias("bits"))
    found = word.toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _codes(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the REACH words after each place's first run, and of those before it (nearest first); 0 beyond the text."""
    code = np.zeros(len(h) + 2 * MIN_WORDS, np.uint16)
    code[MIN_WORDS : MIN_WORDS + len(h)] = 1 + (h >> np.uint64(20)) % np.uint64(65_535)
    reach = np.arange(REACH)
    return code[MIN_WORDS + GRAM + place[:, None] + reach], code[MIN_WORDS - 1 + place[:, None] - reach]


def context_hash(codes: bytes) -> int:
    return xxhash.xxh3_64_intdigest(codes) - (1 << 63)


def _contexts(rows: DataFrame, bits, with_codes: bool) -> DataFrame:
    """A row for each kept suffix that the bit array lets pass: its context, or the context's hash and the place."""

    def work(part, texts, filter_):
        kept, spread = [], []
        for k, t in enumerate(texts):
            h = word_hashes(t)
            place, gram = anchors(h)
            bit = gram >> np.uint64(64 - FILTER_BITS)
            open_ = (filter_[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            place, gram = place[open_], gram[open_]
            if len(place):
                right, left = _codes(h, place)
                data = np.concatenate([gram[:, None].astype(">u8").view(np.uint8).reshape(-1, 8), right.astype(">u2").view(np.uint8), left.astype(">u2").view(np.uint8)], axis=1)
                kept.append((data, place))
                spread += [k] * len(place)
        take = pa.array(spread, pa.int64())
        data = np.concatenate([d for d, _ in kept]) if kept else np.zeros((0, 8 + 4 * REACH), np.uint8)
        raw = [x.tobytes() for x in data]
        ids = [part.column("doc_id").take(take), part.column("row").take(take)]
        if with_codes:
            return [*ids, raw]
        return [*ids, [context_hash(x) for x in raw], np.concatenate([p for _, p in kept]) if kept else np.zeros(0, np.int64)]

    schema = "doc_id long, row long, " + ("codes binary" if with_codes else "context long, place long")
    return map_texts(rows, work, schema, lambda: bits.value)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words two arrays of codes share from their beginning on (rows); text ends match nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _matches(codes: np.ndarray, single: np.ndarray, low: np.ndarray, high: np.ndarray, min_words: int) -> tuple:
    """For each sorted row how far left and right it matches a neighbour of another document, and an id of one."""
    n = len(codes)
    whole = codes.view(">u2").reshape(n, -1)
    gram, right, left = whole[:, :4], whole[:, 4 : 4 + REACH], whole[:, 4 + REACH :]
    back, ahead, other = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    # rows of one and the same document form runs; a run is compared with the rows beside it
    edge = np.ones(n, bool)
    edge[1:] = (single[1:] != single[:-1]) | (single[1:] == 0)
    start = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    stop = np.r_[np.flatnonzero(edge)[1:], n][np.cumsum(edge) - 1]
    for partner in (start - 1, stop):
        i = np.flatnonzero((partner >= 0) & (partner < n))
        j = partner[i]
        near = (gram[i] == gram[j]).all(1)
        i, j = i[near], j[near]
        r, b = GRAM + _same(right[i], right[j]), _same(left[i], left[j])
        good = r + b >= min_words
        i, j, r, b = i[good], j[good], r[good], b[good]
        ahead[i], back[i] = np.maximum(ahead[i], r), np.maximum(back[i], b)
        other[i] = j
    # a context that several documents share matches as far as it goes
    many = single == 0
    full_r, full_l = GRAM + (right[many] != 0).sum(1), (left[many] != 0).sum(1)
    good = full_r + full_l >= min_words
    at = np.flatnonzero(many)[good]
    ahead[at], back[at] = np.maximum(ahead[at], full_r[good]), np.maximum(back[at], full_l[good])
    # of three or more suffixes of one first run, the nearest on the right may not be the one that goes far to the left
    if min_words == MIN_WORDS:
        new = np.r_[True, (gram[1:] != gram[:-1]).any(1)]
        group = np.cumsum(new) - 1
        rows = np.flatnonzero(np.bincount(group)[group] > 2)
        _all_windows(rows, group[rows], right[rows], left[rows], single[rows], back, ahead, other)
    return back, ahead, other


def _all_windows(rows, group, right, left, single, back, ahead, other) -> None:
    """Every window of MIN_WORDS words around these suffixes: those that rows of different documents share count."""
    if not len(rows):
        return
    after = [np.zeros(len(rows), np.uint64)]
    for k in range(REACH):
        after.append((after[-1] + right[:, k] + np.uint64(1)) * MIX)
    n_right, n_left = (right != 0).sum(1), (left != 0).sum(1)
    before = group.astype(np.uint64) * MIX
    for o in range(REACH + 1):
        if o:
            before = (before ^ (before >> np.uint64(29))) * MIX + left[:, o - 1]
        own = np.flatnonzero((n_left >= o) & (n_right >= REACH - o))
        key = before[own] ^ (after[REACH - o][own] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(o))
        order = own[np.argsort(key, kind="stable")]
        if not len(order):
            continue
        key = np.sort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(order)])
        docs = single[order]
        low, high = np.minimum.reduceat(docs, start), np.maximum.reduceat(docs, start)
        shared = np.repeat((low != high) | (low == 0) & (size > 1), size)
        # a row of another document: the first or the last of the sorted ones
        by_doc = order[np.lexsort((docs, np.repeat(np.arange(len(start)), size)))]
        first, last = np.repeat(by_doc[start], size), np.repeat(by_doc[start + size - 1], size)
        partner = np.where(single[first] != docs, first, last)
        hit, near = rows[order[shared]], rows[partner[shared]]
        back[hit], ahead[hit] = np.maximum(back[hit], o), np.maximum(ahead[hit], MIN_WORDS - o)
        other[hit] = np.where(other[hit] < 0, near, other[hit])


def _windows(codes: np.ndarray, others: pa.Table, first: np.ndarray, last: np.ndarray):
    """(words to the left, table) of the windows of MIN_WORDS words around these suffixes, from ``first`` to ``last`` words to the left.

    The table holds the row, the key (equal windows have equal keys) and single, low and high of ``others``.
    """
    whole = codes.view(">u2").reshape(len(codes), -1)
    right, left = whole[:, 4 : 4 + REACH], whole[:, 4 + REACH :]
    n_right, n_left = (right != 0).sum(1), (left != 0).sum(1)
    for o in range(REACH + 1):
        own = np.flatnonzero((n_left >= o) & (n_right >= REACH - o) & (first <= o) & (o <= last))
        if not len(own):
            continue
        # the left part, the first run and the right part are one stretch of bytes, but for the order of the left part
        part = np.concatenate([codes[own, :8], codes[own, 8 : 8 + 2 * (REACH - o)], codes[own, 8 + 2 * REACH : 8 + 2 * REACH + 2 * o]], axis=1)
        key = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes(), o) for x in part), np.uint64, len(own))
        row = pa.array(own)
        yield o, pa.table({"row": row, "key": _signed(key), **{c: others[c].take(row) for c in ("single", "low", "high")}})


def _summed(windows: pa.Table) -> pa.Table:
    """A row for each window: the least and the largest of its rows' documents, their number and their ids."""
    found = windows.group_by("key", use_threads=False).aggregate([("single", "min"), ("single", "max"), ("row", "count"), ("low", "min"), ("high", "max")])
    return pa.table([found[c] for c in ("key", "single_min", "single_max", "row_count", "low_min", "high_max")], names=["key", "first", "last", "n", "one", "two"])


def _of_several(sums: pa.Table) -> pa.Table:
    """Windows of rows of different documents, or of two contexts that several documents each share."""
    first = sums["first"].to_numpy()
    return sums.filter(pa.array((first != sums["last"].to_numpy()) | (first == 0) & (sums["n"].to_numpy() > 1)))


class _Found:
    """How far rows match to the left and right by their windows, and the least id beside."""

    def __init__(self, n: int):
        self.back, self.ahead, self.near, self.known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)

    def add(self, o: int, windows: pa.Table, shared: pa.Table) -> None:
        at = pc.index_in(windows["key"], shared["key"].combine_chunks())
        hit = windows.filter(at.is_valid())
        one, two = (shared[c].take(at.drop_null()) for c in ("one", "two"))
        near = pc.if_else(pc.fill_null(pc.not_equal(one, hit["low"]), False), one, two)
        row = hit["row"].to_numpy()
        self.back[row] = np.maximum(self.back[row], o)
        self.ahead[row] = np.maximum(self.ahead[row], MIN_WORDS - o)
        self.beside(row, near)

    def beside(self, row: np.ndarray, near: pa.ChunkedArray) -> None:
        ok = near.is_valid().to_numpy()
        row, value = row[ok], near.drop_null().to_numpy()
        self.near[row] = np.where(self.known[row], np.minimum(self.near[row], value), value)
        self.known[row] = True


def _reach(rows: np.ndarray, gram: np.ndarray, neighbours: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    """How many words of ``rows`` the farthest reaching of ``neighbours`` (first run, words) shares; -1: another first run."""
    most = np.full(len(rows), -1)
    for own, words in neighbours:
        same = (gram == np.frombuffer(own, np.uint8)).all(1)
        most = np.maximum(most, np.where(same, _same(rows, np.broadcast_to(words, rows.shape)), -1))
    return most


def _spread_matches(ordered: DataFrame, grams: set[bytes], beside) -> DataFrame:
    """What the first runs ``grams``, which lie in several ranges, match: by window, each in the narrowest place that has all its rows."""
    spark, ids = ordered.sparkSession, ["single", "low", "high"]
    wanted = spark.sparkContext.broadcast(grams)
    half = 8 + 2 * REACH
    matrix = lambda codes: np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    wide = lambda data: data.view(">u2").reshape(len(data), -1)

    def inside(batches):
        """Rows of these runs with what their windows match in this range, and how many words to the right reach over its borders."""
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("codes", pa.binary()), *[(c, pa.int64()) for c in ids]]))
        table = table.filter(pa.array([x[:8] in wanted.value for x in table["codes"].to_pylist()], pa.bool_()))
        if not table.num_rows:
            return
        me, data = TaskContext.get().partitionId(), matrix(table["codes"].to_pylist())
        before, after = [x for x in beside.value if x[0] < me and x[1] == 1][-1:], [x for x in beside.value if x[0] > me and x[1] == 0][:1]
        far = _reach(wide(data)[:, 4 : 4 + REACH], data[:, :8], [(x[2][:8], wide(matrix([x[2]]))[0, 4 : 4 + REACH]) for x in before + after])
        found = _Found(len(data))
        for o, w in _windows(data, table, np.zeros(len(data), np.int64), REACH - far - 1):
            found.add(o, w, _of_several(_summed(w)))
        turned = np.concatenate([data[:, :8], data[:, half:], data[:, 8:half]], axis=1)
        columns = [[x.tobytes() for x in turned], *[table[c].combine_chunks() for c in ids], far, found.back, found.ahead, pa.array(found.near, mask=~found.known)]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["codes", *ids, "far", "back", "ahead", "near"])

    schema = "codes binary, single long, low long, high long, far long, back long, ahead long, near long"
    turned = materialise(ordered.mapInArrow(inside, schema).repartitionByRange("codes").sortWithinPartitions("codes"))

    def borders(batches):
        codes = [x[k].as_py() for x in (b.column("codes") for b in batches if b.num_rows) for k in (0, len(x) - 1)]
        if codes:
            yield pa.RecordBatch.from_pylist([{"range": TaskContext.get().partitionId(), "head": codes[0], "tail": codes[-1]}], schema=pa.schema([("range", pa.int32()), ("head", pa.binary()), ("tail", pa.binary())]))

    # one row for each range
    bounds = spark.sparkContext.broadcast(sorted((r.range, bytes(r.head), bytes(r.tail)) for r in turned.select("codes").mapInArrow(borders, "range int, head binary, tail binary").collect()))

    def parts(batches):
        """A range's table, its codes in the first order, and how many words to the left reach over its borders."""
        table = pa.Table.from_batches(list(batches))
        me, data = TaskContext.get().partitionId(), matrix(table["codes"].to_pylist())
        ends = [x[2] for x in bounds.value if x[0] < me][-1:] + [x[1] for x in bounds.value if x[0] > me][:1]
        over = _reach(wide(data)[:, 4 : 4 + REACH], data[:, :8], [(x[:8], wide(matrix([x]))[0, 4 : 4 + REACH]) for x in ends])
        return table, np.concatenate([data[:, :8], data[:, half:], data[:, 8:half]], axis=1), over

    def crossing(batches):
        if not (batches := [b for b in batches if b.num_rows]):
            return
        table, data, over = parts(batches)
        for _, w in _windows(data, table, REACH - table["far"].to_numpy(), over):
            yield from _summed(w).combine_chunks().to_batches()

    sums = turned.mapInArrow(crossing, "key long, first long, last long, n long, one long, two long").groupBy("key").agg(
        *[f(c).alias(c) for f, c in ((F.min, "first"), (F.max, "last"), (F.sum, "n"), (F.min, "one"), (F.max, "two"))]
    )
    # a few windows for each pair of borders
    shared = spark.sparkContext.broadcast(sums.where("first <> last OR first = 0 AND n > 1").select("key", "one", "two").toArrow())

    def resolve(batches):
        if not (batches := [b for b in batches if b.num_rows]):
            return
        table, data, over = parts(batches)
        found, first = _Found(len(data)), REACH - table["far"].to_numpy()
        found.back, found.ahead = (table[c].to_numpy().copy() for c in ("back", "ahead"))
        found.beside(np.arange(len(data)), table["near"])
        for o, w in _windows(data, table, np.maximum(first, over + 1), np.full(len(data), REACH)):
            found.add(o, w, _of_several(_summed(w)))
        for o, w in _windows(data, table, first, over):
            found.add(o, w, shared.value)
        own = np.flatnonzero(found.ahead)
        pick = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([context_hash(x.tobytes()) for x in data[own]], pa.int64()), pa.array(found.back[own]), pa.array(found.ahead[own]), *[table[c].take(pick).combine_chunks() for c in ("low", "high")],
             pa.array(found.near[own], mask=~found.known[own])],
            names=["context", "back", "ahead", "low", "high", "near"],
        )

    # saved before it joins other rows: in a union, the numbers of the ranges would be others
    return materialise(turned.mapInArrow(resolve, "context long, back long, ahead long, low long, high long, near long"))


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start, end, other_docs): every passage of ``min_words`` or more words that other documents hold too.

    start and end count words of the document; touching and overlapping passages are one. ``other_docs`` are some ids that
    hold parts of it: for each matching suffix one of its copies or neighbours.
    """
    rows = _rows(docs)
    bits = docs.sparkSession.sparkContext.broadcast(_repeated(rows))
    classes = (
        _contexts(rows, bits, True).groupBy("codes")
        .agg(F.min("row").alias("low_row"), F.max("row").alias("high_row"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    )
    ordered = materialise(
        classes.select("codes", F.when(F.col("low_row") == F.col("high_row"), F.col("low_row")).otherwise(0).alias("single"), "low", "high")
        .repartitionByRange("codes").sortWithinPartitions("codes")
    )
    names = ["codes", "single", "low", "high"]
    arrow = pa.schema([("codes", pa.binary()), *[(c, pa.int64()) for c in names[1:]]])

    def ends(batches):
        """The first and the last rows of a range that neighbours may need: up to a row of another document."""
        table = pa.Table.from_batches(list(batches), schema=arrow)
        if not table.num_rows:
            return
        single = table["single"].to_numpy()
        differs = np.flatnonzero((single != single[0]) | (single == 0))
        first = {0, int(differs[0]) if len(differs) else 0}
        differs = np.flatnonzero((single != single[-1]) | (single == 0))
        last = {table.num_rows - 1, int(differs[-1]) if len(differs) else table.num_rows - 1}
        for side, places in ((0, first), (1, last)):
            for k in sorted(places):
                yield pa.RecordBatch.from_pylist([{**table.slice(k, 1).to_pylist()[0], "side": side, "range": TaskContext.get().partitionId()}], schema=edges)

    edges = pa.schema([*arrow, ("side", pa.int32()), ("range", pa.int32())])
    # at most four rows for each range
    bounds = ordered.mapInArrow(ends, "codes binary, single long, low long, high long, side int, range int").collect()
    beside = docs.sparkSession.sparkContext.broadcast(sorted(((r.range, r.side, bytes(r.codes), r.single, r.low, r.high) for r in bounds), key=lambda x: x[:3]))

    # first runs in several ranges: each is the first or the last one of every range that holds it
    held: dict[bytes, set[int]] = {}
    for r in bounds:
        held.setdefault(bytes(r.codes[:8]), set()).add(r.range)
    spread = {gram for gram, ranges in held.items() if len(ranges) > 1}

    def compare(batches):
        table = pa.Table.from_batches(list(batches), schema=arrow)
        if not table.num_rows:
            return
        me = TaskContext.get().partitionId()
        before, after = [x for x in beside.value if x[0] < me and x[1] == 1], [x for x in beside.value if x[0] > me and x[1] == 0]
        before = [x for x in before if x[0] == before[-1][0]] if before else []
        after = [x for x in after if x[0] == after[0][0]] if after else []
        extra = [[dict(zip(names, x[2:])) for x in part] for part in (before, after)]
        whole = pa.concat_tables([pa.Table.from_pylist(extra[0], schema=arrow), table, pa.Table.from_pylist(extra[1], schema=arrow)])
        codes = np.frombuffer(b"".join(whole["codes"].to_pylist()), np.uint8).reshape(whole.num_rows, -1)
        low, high = whole["low"].to_pylist(), whole["high"].to_pylist()
        back, ahead, other = _matches(codes, whole["single"].to_numpy(), low, high, min_words)
        own = np.arange(len(before), len(before) + table.num_rows)
        own = own[ahead[own] + back[own] > 0]
        pick = pa.array(own)
        near = [low[k] if k >= 0 else None for k in other[own].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([context_hash(x) for x in whole["codes"].take(pick).to_pylist()], pa.int64()), pa.array(back[own]), pa.array(ahead[own]), whole["low"].take(pick).combine_chunks(),
             whole["high"].take(pick).combine_chunks(), pa.array(near, pa.int64())],
            names=["context", "back", "ahead", "low", "high", "near"],
        )

    found = ordered.mapInArrow(compare, "context long, back long, ahead long, low long, high long, near long")
    if spread and min_words == MIN_WORDS:
        found = found.union(_spread_matches(ordered, spread, beside))
    spots = _contexts(rows, bits, False).join(found, "context")
    span = F.struct((F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end"), "others")
    other = F.array_compact(F.array(F.when(F.col("low") != F.col("doc_id"), F.col("low")), F.when(F.col("high") != F.col("doc_id"), F.col("high")), F.when(F.col("near") != F.col("doc_id"), F.col("near"))))
    merged = F.expr("""
        aggregate(array_sort(spans), CAST(array() AS array<struct<start: bigint, end: bigint, others: array<bigint>>>), (done, s) ->
          CASE WHEN size(done) > 0 AND s.start <= element_at(done, -1).end
            THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                   'end', greatest(s.end, element_at(done, -1).end), 'others', array_union(element_at(done, -1).others, s.others))))
            ELSE concat(done, array(s)) END)""")
    return (
        spots.withColumn("others", other).groupBy("doc_id", "row").agg(F.collect_set(span).alias("spans"))
        .select("doc_id", "row", F.inline(merged)).withColumnRenamed("others", "other_docs")
    )
