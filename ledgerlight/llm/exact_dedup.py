"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every scan task hashes its normalised texts and sends, to the owner of each hash range, one sorted and compressed list of
short fingerprints (each fingerprint once, however often it occurs there). An owner answers each sender with a bitmap of
those that another sender has too. Only documents whose bit is set, or that meet a copy within their own task, are
suspects; their texts alone are shuffled and compared byte by byte. A short fingerprint that two texts share by chance
costs one needless comparison.

Texts are equal when identical after all ASCII white space is deleted; null counts as empty. Of equal texts the row with
the most code points in its original text stays, then the smallest id (null ids last, repeated rows once). Every row is
returned, repeated rows and null ids included; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm import golomb
from ledgerlight.llm.common import map_texts
from ledgerlight.session import materialise

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of a fingerprint beyond the logarithm of the number of rows: one in 256 unique texts is a suspect by chance.
SPARE_BITS = 8
#: Fingerprints that one owner compares.
OWNER_ROWS = 1_000_000


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, BLANKS)


def _signed(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data, 42)
    return value - (1 << 64) if value >> 63 else value


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(doc_id, text_key, n_chars, h, sha) of every row, and the normalised bytes if asked for; text_key hashes the text as it is."""

    def work(part, texts):
        data = [normalised(t) for t in texts]
        out = [part.column("doc_id"), part.column("text_key"), [len(t) for t in texts], [_signed(x) for x in data], [hashlib.sha256(x).digest() for x in data]]
        return out + [data] * with_bytes

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key, F.col(text_col).alias("text"))
    return map_texts(rows, work, "doc_id long, text_key long, n_chars long, h long, sha binary" + ", body binary" * with_bytes)


def suspects(prints: DataFrame, rows: int, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(doc_id, h) of the saved ``prints`` (with column ``sender``) whose fingerprint some other row may share."""
    bits = max(1, rows).bit_length() + SPARE_BITS
    owners = -(-rows // owner_rows)
    shift, limit = np.uint64(64 - bits), 1 << bits

    def short(h) -> np.ndarray:
        return np.asarray(h, np.int64).view(np.uint64) >> shift

    def owner_of(f: np.ndarray) -> np.ndarray:
        return (f * np.uint64(owners)) >> np.uint64(bits)

    def send(batches):
        """One list for each owner from all rows of the task, 8 bytes a row."""
        sender, held = None, []
        for b in batches:
            if b.num_rows:
                sender = b.column("sender")[0].as_py()
                held.append(b.column("h").to_numpy())
        if sender is None:
            return
        found = np.unique(short(np.concatenate(held)))
        cuts = np.searchsorted(owner_of(found), np.arange(owners + 1))
        for k in range(owners):
            own = found[cuts[k] : cuts[k + 1]]
            if len(own):
                data, width = golomb.encode(own, limit)
                yield pa.RecordBatch.from_pylist([{"owner": k, "sender": sender, "n": len(own), "width": width, "data": data}], schema=sent)

    sent = pa.schema([("owner", pa.int64()), ("sender", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("data", pa.binary())])

    def answer(lists: pd.DataFrame) -> pd.DataFrame:
        """What several senders have, as one bitmap for each sender."""
        sets = [golomb.decode(d, w, n) for d, w, n in zip(lists["data"], lists["width"], lists["n"])]
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        shared = found[counts > 1]
        maps = [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sets]
        return pd.DataFrame({"sender": lists["sender"], "owner": lists["owner"], "n": lists["n"], "bitmap": maps})

    def mark(own: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        """The sender's rows that are set in a bitmap or meet a copy among themselves."""
        f = short(own["h"].to_numpy())
        found, place, counts = np.unique(f, return_inverse=True, return_counts=True)
        maps = maps.sort_values("owner")
        seen = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[:n] for m, n in zip(maps["bitmap"], maps["n"])])
        return own.loc[(seen.astype(bool) | (counts > 1))[place], ["doc_id", "h"]]

    lists = prints.select("sender", "h").mapInArrow(send, "owner long, sender long, n long, width int, data binary")
    bitmaps = lists.groupBy("owner").applyInPandas(answer, "sender long, owner long, n long, bitmap binary")
    own = prints.select("sender", "doc_id", "h")
    return own.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(
        lambda a, b: mark(a, b) if len(a) else a[["doc_id", "h"]], "doc_id long, h long"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(doc_id, text_key, keep_id, group_size, kept, sha) for every row of ``docs``."""
    prints = materialise(digests(docs, id_col, text_col).withColumn("sender", F.spark_partition_id().cast("long")))
    asked = materialise(suspects(prints, prints.count(), owner_rows).select("doc_id", "h").distinct())
    ids = asked.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, F.expr("doc_id <=> _id"), "left_semi")
    # equal hash, digest and bytes: copies meet in the map-side part of this aggregation
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("less")))
    groups = (
        digests(texts, with_bytes=True).groupBy("h", "sha", "body").agg(best.alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("h", "sha", "group_size", F.col("best.n_chars").alias("keep_chars"), (-F.col("best.less")).alias("keep_id"))
    )
    found = materialise(prints.drop("sender").join(groups, ["h", "sha"], "left"))
    columns = ("doc_id", "text_key", "keep_id", "group_size", "kept", "sha")
    alone = found.where("group_size IS NULL").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    copies = found.where("group_size IS NOT NULL")
    best_row = F.expr("doc_id <=> keep_id AND n_chars = keep_chars")
    once = Window.partitionBy("h", "sha").orderBy("text_key")
    stays = copies.where(best_row).withColumn("kept", F.row_number().over(once) == 1)
    parts = (alone, copies.where(~best_row).withColumn("kept", F.lit(False)), stays)
    return parts[0].select(*columns).union(parts[1].select(*columns)).union(parts[2].select(*columns))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    found = exact_duplicates(docs).where("group_size > 1")
    units = materialise(found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")))
    same = F.expr("doc_id <=> _id AND xxhash64(coalesce(text, '')) = _key")
    kept = docs.join(units.where("NOT _kept").select("_id", "_key"), same, "left_anti")
    again = units.where("_kept AND _n > 1").select("_id", "_key")
    if not again.take(1):
        return kept
    # whole rows that repeat: one of them stays
    order = Window.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(*docs.columns)
    first = kept.join(again, same, "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return kept.join(again, same, "left_anti").union(first)
