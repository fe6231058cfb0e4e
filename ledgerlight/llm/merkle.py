"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A row is a leaf; per language, leaves in order of their ids are hashed in runs of eight until one digest remains, and the
languages' digests are hashed likewise to the root. A parent keeps the state of its hash *before each child slot*. To check a
row, its leaf (possibly of a changed text) is folded to the root: the state kept before its slot is resumed with the
replacement and the siblings to the right only; what lies to the left is never hashed again.

Spark sorts the narrow leaves by range, numbers them from the ranges' counts, and deals them in blocks of 512 (three levels);
blocks are built in whole batches and are the nodes of the next round, so no language is ever in one task. States and
digests stay in a table; paths go back down block by block. The rounds are log512 of the rows.

Defined results: null fields count as ``-``; a null id sorts first and is never tampered with; rows with one id are ordered
by their leaf, repeated rows are leaves of their own; empty texts have a leaf like others; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlight.llm import midstate
from ledgerlight.llm.common import small_batches
from ledgerlight.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 8, 3
SPAN = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "path array<struct<state: binary, left: binary, right: binary>>"
BLOCK = "tree string, block long, n long, ids array<long>, altered binary, nodes array<binary>, states array<binary>, top binary"
#: Blocks whose arrays are worked on together.
RUN = 32


def leaf(columns: dict[str, Column]) -> Column:
    """Digest (binary) of the fields of a row, each with its length."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, id, digest, altered): the leaf of a row, and the one after tampering where its turn has come."""
    own = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = leaf(own | {"text": F.translate("text", UPPER, LOWER)})
    # a marker keeps the null language apart from the empty one, and first
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf(own).alias("digest"), F.when(chosen, tampered).alias("_new"))
    return rows.select("tree", "id", "digest", F.coalesce("_new", "digest").alias("altered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``pos`` (from 0) in the order within the tree, and ``n``, its rows; ranges are counted, never a whole tree sorted in one task."""
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    saved = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    ranges = saved.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    return saved.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, RUN):
            yield batch.slice(start, RUN)


def _digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All digests of a column of lists, and the length of each list."""
    lists = column.to_pylist()
    return midstate.unpack(b"".join(b"".join(x) for x in lists)), np.array([len(x) for x in lists], np.int64)


def _inside(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths laid end to end: the list of each item and its place in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def grow(digests: np.ndarray, counts: np.ndarray, n: np.ndarray) -> tuple[list[list[bytes]], list[list[bytes]], np.ndarray]:
    """Per block its nodes and the states before their slots, level by level, and its top; ``n`` are the nodes of the whole tree."""
    nodes: list[list[bytes]] = [[] for _ in counts]
    states: list[list[bytes]] = [[] for _ in counts]
    level, counts, large = 0, counts.copy(), n > SPAN
    while (open_ := np.where(large, level < LEVELS, counts > 1)).any():
        owner, place = _inside(counts)
        mine = np.flatnonzero(open_[owner])
        parents = np.where(open_, -(-counts // FAN), 0)
        first = np.cumsum(parents) - parents
        parent, slot = first[owner[mine]] + place[mine] // FAN, place[mine] % FAN
        blocks, before, now = midstate.hex_blocks(digests[mine]), np.empty((len(mine), 8), np.uint32), midstate.fresh(int(parents.sum()))
        for s in range(FAN):
            if len(at := np.flatnonzero(slot == s)):
                before[at] = now[parent[at]]
                now[parent[at]] = midstate.compress(before[at], blocks[at])
        ends = np.cumsum(np.where(open_, counts, 0))
        for b in np.flatnonzero(open_):
            part = slice(ends[b] - counts[b], ends[b])
            nodes[b].append(midstate.pack(digests[mine[part]]))
            states[b].append(midstate.pack(before[part]))
        made = midstate.finish(now, np.bincount(parent, minlength=len(now)))
        rest = np.flatnonzero(~open_[owner])
        order = np.argsort(np.concatenate([np.repeat(np.arange(len(counts)), parents), owner[rest]]), kind="stable")
        digests, counts, level = np.concatenate([made, digests[rest]])[order], np.where(open_, parents, counts), level + 1
    return nodes, states, digests


def build(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (tree, pos, n, id, digest, altered) with the digests and states of their levels."""
    block = F.floor(F.col("pos") / SPAN)
    item = F.struct("pos", "id", "digest", "altered")
    dealt = rows.groupBy("tree", block.alias("block"), "n").agg(F.array_sort(F.collect_list(item)).alias("items"))
    dealt = dealt.select("tree", "block", "n", F.col("items.id").alias("ids"), F.col("items.digest").alias("digest"), F.col("items.altered").alias("altered"))
    schema = to_arrow_schema(StructType.fromDDL(BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            digests, counts = _digests(part.column("digest"))
            nodes, states, tops = grow(digests, counts, part.column("n").to_numpy())
            altered = [b"".join(x) for x in part.column("altered").to_pylist()]
            tops = [midstate.pack(t) for t in tops]
            lone = part.column("digest").to_pylist()
            nodes = [x or [lone[i][0]] for i, x in enumerate(nodes)]
            columns = [part.column("tree"), part.column("block"), part.column("n"), part.column("ids"), altered, nodes, states, tops]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, BLOCK)


def _siblings(data: bytes, i: int) -> tuple[bytes, bytes]:
    """Digests left and right of node ``i`` in its run."""
    start = i - i % FAN
    return data[32 * start : 32 * i], data[32 * i + 32 : 32 * min(start + FAN, len(data) // 32)]


def paths(blocks: DataFrame) -> DataFrame:
    """From blocks with their own path to one row a node: (tree, block, subroot, root, path), block being the node's place."""
    ddl = f"tree string, block long, subroot binary, root binary, {PATH}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for i in range(len(r["nodes"][0]) // 32):
                    path, at = [], i
                    for nodes, states in zip(r["nodes"], r["states"]):
                        left, right = _siblings(nodes, at)
                        path.append({"state": states[32 * at : 32 * at + 32], "left": left, "right": right})
                        at //= FAN
                    out.append((r["tree"], r["block"] * SPAN + i, r["subroot"], r["root"], path + r["path"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return blocks.select("tree", "block", "nodes", "states", "subroot", "root", "path").mapInArrow(run, ddl)


def resume(now: np.ndarray, states: np.ndarray, pool: np.ndarray, first: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Digests of the parents when ``now`` takes its slot: the kept state goes on with it and ``after`` blocks of ``pool`` from ``first``."""
    states = midstate.compress(states, midstate.hex_blocks(now))
    for t in range(FAN - 1):
        if not len(at := np.flatnonzero(after > t)):
            break
        states[at] = midstate.compress(states[at], pool[first[at] + t])
    return midstate.finish(states, size)


def fold(rows: list[dict]) -> tuple[np.ndarray, list[str]]:
    """For all leaves of the blocks: the root that the altered leaf gives, and the digest of all its siblings."""
    counts = np.array([len(r["ids"]) for r in rows])
    owner, place = _inside(counts)
    now = midstate.unpack(b"".join(r["altered"] for r in rows))
    proofs: list[list[bytes]] = [[] for _ in owner]
    for level in range(max(len(r["states"]) for r in rows)):
        held = [len(r["states"][level]) // 32 if len(r["states"]) > level else 0 for r in rows]
        size, start = np.array(held), np.cumsum(held) - held
        at = np.flatnonzero(size[owner] > 0)
        node = place[at] // FAN**level
        slot, own = node % FAN, owner[at]
        run = np.minimum(FAN, size[own] - (node - slot))
        data = b"".join(r["nodes"][level] for r in rows if len(r["states"]) > level)
        pool = midstate.hex_blocks(midstate.unpack(data))
        states = midstate.unpack(b"".join(r["states"][level] for r in rows if len(r["states"]) > level))
        index = start[own] + node
        now[at] = resume(now[at], states[index], pool, index + 1, run - slot - 1, run)
        for i, j, s, k in zip(at.tolist(), index.tolist(), slot.tolist(), run.tolist()):
            proofs[i] += (data[32 * (j - s) : 32 * j], data[32 * j + 32 : 32 * (j - s + k)])
    for level in range(max(len(r["path"]) for r in rows)):
        steps = [r["path"][level] if len(r["path"]) > level else None for r in rows]
        right = np.array([len(s["right"]) // 32 if s else 0 for s in steps])
        total = np.array([len(s["left"]) // 32 + 1 if s else 0 for s in steps]) + right
        at = np.flatnonzero(total[owner] > 0)
        own = owner[at]
        pool = midstate.hex_blocks(midstate.unpack(b"".join(s["right"] for s in steps if s)))
        states = midstate.unpack(b"".join(s["state"] if s else bytes(32) for s in steps))
        now[at] = resume(now[at], states[own], pool, (np.cumsum(right) - right)[own], right[own], total[own])
    above = [b"".join(s["left"] + s["right"] for s in r["path"]).hex() for r in rows]
    return now, [hashlib.sha256((b"".join(p).hex() + above[o]).encode()).hexdigest() for p, o in zip(proofs, owner)]


def folded(blocks: DataFrame) -> DataFrame:
    """One row a leaf of blocks with their paths."""
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            rows = part.to_pylist()
            roots, proofs = fold(rows)
            text = midstate.pack(roots).hex()
            out, k = [], 0
            for r in rows:
                own, sub, root = r["nodes"][0].hex(), r["subroot"].hex(), r["root"].hex()
                for i, doc in enumerate(r["ids"]):
                    found = text[64 * k : 64 * k + 64]
                    out.append((doc, own[64 * i : 64 * i + 64], sub, root, proofs[k], found, found == root))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return blocks.select("ids", "altered", "nodes", "states", "subroot", "root", "path").mapInArrow(run, ddl)


def raised(rows: DataFrame, largest: int) -> list[DataFrame]:
    """The rounds of blocks (saved) from leaves to the tops of all trees; ``largest``: rows of the largest tree."""
    rounds = []
    while True:
        rounds.append(materialise(build(rows)))
        if largest <= SPAN:
            return rounds
        largest = -(-largest // SPAN)
        rows = rounds[-1].where(F.col("n") > SPAN).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.lit(None).cast("long").alias("id"), F.col("top").alias("digest"), F.col("top").alias("altered")
        )


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top) of the finished trees."""
    parts = [r.where(F.col("n") <= SPAN).select("tree", "top") for r in rounds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lowered(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The leaves' blocks with their paths; ``ends`` holds (tree, subroot, root, path) for the top of every tree."""
    above = None
    for blocks in reversed(rounds):
        whole = blocks.where(F.col("n") <= SPAN).join(ends, "tree")
        if above is not None:
            whole = whole.unionByName(blocks.where(F.col("n") > SPAN).join(above, ["tree", "block"]))
        above = materialise(paths(whole)) if blocks is not rounds[0] else whole
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    small_batches(docs.sparkSession)
    rows = placed(materialise(leaves(docs)), "id", "digest")
    own = raised(rows, int(rows.agg(F.max("n")).first()[0] or 0))
    named = tops(own).select(F.col("tree").alias("lang_tree"), F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), F.col("top").alias("digest"), F.col("top").alias("altered"))
    langs = materialise(placed(named, "lang_tree"))
    upper = raised(langs.drop("lang_tree"), int(langs.agg(F.max("n")).first()[0] or 0))
    end = tops(upper).select("tree", F.col("top").alias("subroot"), F.col("top").alias("root"), F.expr(f"CAST(array() AS {PATH.removeprefix('path ')})").alias("path"))
    ways = paths(lowered(upper, end)).join(langs.select("lang_tree", F.col("pos").alias("block"), "digest"), "block")
    ends = materialise(ways.select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    return folded(lowered(own, ends))
