"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the longest known phrase and one more character). The set of phrases is
hashed into SLOTS classes; of each class the smallest hash is kept, 16 bits of it. The share of equal slots among those
that either fingerprint fills estimates how much of their dictionaries two documents share, which is close to how well one
compresses the other.

``neighbour_fingerprints`` also fingerprints each document's edited text (its last half replaced by the beginning of the
next document). Documents are dealt by ranges of their ids, each range with a copy of the first document of the next one;
a task reads them in order and keeps two parses in memory, and the half that both texts share is parsed once.

Null texts count as empty. Null ids come first; equal ids follow each other by text. The next document of the last one is
the first, so a single document is its own. Equal texts have equal fingerprints; two empty texts have likeness 1, an empty
and another text 0. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import map_texts, small_batches, text_runs

SLOTS = 128
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
HEX = np.array([f"{i:02x}" for i in range(256)])


def parse(text: str, known: dict[str, None], phrase: str = "") -> str:
    """Add the phrases of ``text`` to ``known``; the unfinished last phrase is returned and goes on with the next text."""
    for c in text:
        phrase += c
        if phrase not in known:
            known[phrase] = None
            phrase = ""
    return phrase


def slots(phrases: list[str]) -> np.ndarray:
    """Smallest hash of each class of phrases, EMPTY where there is none."""
    out = np.full(SLOTS, EMPTY)
    if not phrases:
        return out
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    # every character is mixed with its place, the sum of a phrase once more
    h = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = np.add.reduceat(h, starts) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    np.minimum.at(out, (h % np.uint64(SLOTS)).astype(np.int64), h // np.uint64(SLOTS))
    return out


def printed(kept: np.ndarray) -> str:
    """A fingerprint as text: four hex digits for each slot, ``----`` for an empty one."""
    low = (kept & np.uint64(0xFFFF)).astype("<u2").view(np.uint8).reshape(-1, 2)
    return "".join(np.where(kept == EMPTY, "----", np.char.add(HEX[low[:, 1]], HEX[low[:, 0]])))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal slots among those filled in either; 1 if both are empty."""
    filled = (a != EMPTY) | (b != EMPTY)
    same = (a & np.uint64(0xFFFF)) == (b & np.uint64(0xFFFF))
    same &= (a != EMPTY) & (b != EMPTY)
    return float(same.sum() / filled.sum()) if filled.any() else 1.0


def fingerprint_of(text: str) -> np.ndarray:
    known: dict[str, None] = {}
    rest = parse(text, known)
    return slots([*known, rest] if rest else list(known))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, lambda part, texts: [part.column("doc_id"), [printed(fingerprint_of(t)) for t in texts]], "doc_id long, fingerprint string")


class _Open:
    """A document whose next one has not come yet: its parse up to where the edited text begins to differ."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.n = doc_id, len(text)
        self.head = text[: self.n - self.n // 2]
        self.known: dict[str, None] = {}
        self.rest = parse(self.head, self.known)
        self.base = slots(list(self.known))
        own = self.known.copy()
        rest = parse(text[len(self.head) :], own, self.rest)
        self.slots = self._with(own, rest)

    def _with(self, known: dict[str, None], rest: str) -> np.ndarray:
        return np.minimum(self.base, slots([*islice(known, len(self.known), None), *([rest] if rest else [])]))

    def closed(self, after: str, other: np.ndarray) -> tuple:
        """The row of this document, given the next one's text and slots."""
        tail = after[: self.n // 2]
        known = self.known.copy()
        edited = self._with(known, parse(tail, known, self.rest))
        digest = hashlib.sha256((self.head + tail).encode("utf-8", "surrogatepass")).hexdigest()
        return (self.doc_id, self.n, digest, printed(self.slots), printed(edited), likeness(self.slots, edited), likeness(self.slots, other))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that of the next document."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket)
    # the first id of each range: one row a range
    firsts = rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(
        F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("no_id")
    ).orderBy("bucket").collect()
    # a range's first document is also read after the range before it, the very first one after the last range
    before, lows, null_first = [0] * parts, [f.low for f in firsts if not f.no_id], any(f.no_id for f in firsts)
    for k, f in enumerate(firsts):
        before[f.bucket] = firsts[k - 1].bucket
    is_first = F.when(F.col("doc_id").isNull(), null_first).otherwise(F.col("doc_id").isin(lows) if lows else F.lit(False))
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    again = F.struct(F.element_at(F.array(*map(F.lit, before)), F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(is_first, F.array(own, again)).otherwise(F.array(own))
    placed = rows.withColumn("bucket", bucket)
    dealt = placed.select("doc_id", "text", F.inline(places)).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        before, at, over = None, None, False
        for batch in batches:
            for part, texts in text_runs(batch):
                out = []
                ids, buckets, guest = (part.column(c).to_pylist() for c in ("doc_id", "bucket", "guest"))
                for i, b, g, t in zip(ids, buckets, guest, texts):
                    if b != at:
                        before, at, over = None, b, False
                    if over:  # more guests of one id: the first is the next document
                        continue
                    now = None if g else _Open(i, t)
                    if before is not None:
                        out.append(before.closed(t, fingerprint_of(t) if g else now.slots))
                    before, over = now, g
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return dealt.mapInArrow(run, SCHEMA)
