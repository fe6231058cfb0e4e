"""SimHash near-duplicates: 64-bit fingerprints linked by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits differ in at most one bit
of one of them, so looking up the ball of radius 1 around a segment value in a table of segment values finds every pair;
the distance of the whole fingerprints is verified in the join. Copies are merged into one fingerprint before anything is
looked up. A segment value shared by very many different fingerprints is not paired up: its members meet at the points
between them, which gives the same components with a number of rows in proportion to the members.

Null texts count as empty (fingerprint zero). Null ids keep their row; a component of null ids alone has a null id.
Repeated rows stay repeated; other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import map_texts
from ledgerlight.llm.components import connected_components
from ledgerlight.session import materialise

MAX_BITS = 3
HALF = 32
#: Members of a segment value beyond which they meet at midpoints instead of being compared in pairs.
BUCKET_LIMIT = 2_000


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """SimHash as signed 64-bit integer; words are cut at ASCII white space, only A-Z is lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    starts = []
    for w in words:
        starts.append(at + 1)
        at += 1 + len(w)
        ends.append(at)
    last = max(1, len(words) - shingle + 1)
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(joined[s:e], 42) for s, e in zip(starts[:last], ends[min(shingle, len(words)) - 1 :])), np.uint64, last)
    bits = np.zeros(64, np.int64)
    for k in range(0, last, 65_536):
        bits += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > last, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) for every row: a hash of the whole text and the fingerprint, as signed longs."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
    )

    def work(part, texts):
        return [part.column("doc_id"), part.column("text_key"), [fingerprint_of(t, shingle) for t in texts]]

    return map_texts(rows, work, "doc_id long, text_key long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """(fp, seg, value, rest): each half of a fingerprint with the other half."""
    low, high = F.expr("fp & 4294967295"), F.shiftrightunsigned("fp", HALF)
    cell = lambda k, own, other: F.struct(F.lit(k).alias("seg"), own.alias("value"), other.alias("rest"))
    return fps.select("fp", F.inline(F.array(cell(0, low, high), cell(1, high, low))))


def _ball(value: Column, radius: int, downwards: bool = False) -> Column:
    """The values within ``radius`` bits of a 32-bit value; ``downwards`` only clears bits (the other side then sets them)."""
    bits = F.sequence(F.lit(0), F.lit(HALF - 1))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    used = F.filter(bits, lambda i: value.bitwiseAND(one(i)) != 0) if downwards else bits
    ball = F.concat(F.array(value), F.transform(used, lambda i: value.bitwiseXOR(one(i))))
    if radius == 2:
        pairs = F.flatten(F.transform(bits, lambda i: F.transform(F.filter(bits, lambda j: j > i), lambda j: value.bitwiseXOR(one(i)).bitwiseXOR(one(j)))))
        ball = F.concat(ball, pairs)
    return ball


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at MAX_BITS or fewer differing bits.

    Within a segment value of more than ``bucket_limit`` members only as many pairs as connect the same components.
    """
    table = _segments(fps)
    hot = materialise(table.groupBy("seg", "value").count().where(F.col("count") > bucket_limit).select("seg", "value"))
    any_hot = bool(hot.take(1))
    # of two values one bit apart, one has that bit set; it alone looks the other up
    probes = table.select("fp", "seg", "rest", F.col("value").alias("own"), F.explode(_ball(F.col("value"), 1, downwards=True)).alias("value"))
    cold_table, cold_probes = table, probes
    if any_hot:
        cold_table, cold_probes = (x.join(hot, ["seg", "value"], "left_anti") for x in (table, probes))
    p, t = cold_probes.alias("p"), cold_table.alias("t")
    found = p.join(
        t,
        F.expr(f"p.seg = t.seg AND p.value = t.value AND (p.own <> t.value OR p.fp < t.fp) AND bit_count(p.fp ^ t.fp) <= {MAX_BITS}"),
    ).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    if any_hot:
        found = found.union(_met(table.join(hot, ["seg", "value"]), probes.where("own <> value").join(hot, ["seg", "value"])))
    return found


def _met(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Links inside hot segment values, by the points of the other half that lie between two members.

    Members of one value are within three bits if some point is one bit from one and two from the other; a member and a
    probe (one bit off already) are within two if some point is at most one bit from both. All that meet at a point link
    to one of them.
    """
    spot = ["seg", "value", "point"]
    rest = F.col("rest")
    at = lambda df, radius: df.select("fp", "seg", "value", F.explode(_ball(rest, radius)).alias("point"))
    near, far, others = at(members, 1), at(members, 2), at(probes, 1)
    centre = near.groupBy(*spot).agg(F.min("fp").alias("b"))
    other = others.groupBy(*spot).agg(F.min("fp").alias("b"))
    pairs = [x.join(y, spot).select(F.col("fp").alias("a"), "b") for x, y in ((far, centre), (others, centre), (near, other))]
    return pairs[0].union(pairs[1]).union(pairs[2]).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, text_key, fp, component_id, component_size) for every row of ``docs``; component_id is the smallest id reachable."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n")))
    parts = connected_components(links(fps.select("fp"), bucket_limit))
    owned = fps.join(parts, fps.fp == parts.node, "left").select("fp", "low_id", "n", F.coalesce("component", "fp").alias("component"))
    ids = owned.groupBy("component").agg(F.min("low_id").alias("component_id"), F.sum("n").alias("component_size"))
    classes = owned.select("fp", "component").join(ids, "component").select("fp", "component_id", "component_size")
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id", "component_size")


def representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Rows without an id go only where a document with an id stands for them.
    """
    found = near_duplicates(docs, shingle=shingle).where("component_size > 1 AND NOT doc_id <=> component_id")
    lost = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = F.expr("doc_id <=> _id AND xxhash64(coalesce(text, '')) = _key")
    return docs.join(lost, same, "left_anti")
