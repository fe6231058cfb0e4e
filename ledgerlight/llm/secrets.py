"""Secret scan with corpus-wide ownership.

Every whole text is searched once for candidates: assignments, access keys, hex strings (the base kinds), and long tokens
of mixed letters and digits outside those. Candidate values travel as hashes only. The corpus then tells what they are: a
value found with many owners or in many repositories, even of one owner, is a copied example; one that stays with few of
both looks like a live credential. Base spans are always reported; a long token only where ownership says that it is live.

Values are counted by (value, owner, repository) first, so a value that a third of all rows holds is combined before it is
shuffled; no text and no value is ever shuffled, only hashes. Null texts count as empty, a null owner or repository as one
of its own; repeated rows with one id are one document's rows and stay apart; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import map_texts
from ledgerlight.session import materialise

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
TOKEN = re.compile("[A-Za-z0-9_-]{24,}")
MIXED = re.compile("(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])")
#: Owners, and repositories, from which on a value is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 10


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) in code points, by start and kind; matches of a kind do not overlap, too short ones are dropped."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    for m in TOKEN.finditer(text):
        if MIXED.match(m[0]) and not any(s < m.end() and m.start() < e for s, e, *_ in base):
            found.append((m.start(), m.end(), 3, m[0]))
    return sorted(found, key=lambda x: (x[0], x[2]))


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(row_key, doc_id, owner, repo, found array<struct<start, end, kind, value_hash>>) of every row."""

    def work(part, texts):
        found = [
            [{"start": s, "end": e, "kind": k, "value_hash": xxhash.xxh3_64_intdigest(v.encode()) - (1 << 63)} for s, e, k, v in candidates(t)] for t in texts
        ]
        return [part.column("doc_id"), part.column("owner"), part.column("repo"), found]

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), "text"
    )
    return map_texts(rows, work, "doc_id long, owner string, repo string, found array<struct<start: long, end: long, kind: int, value_hash: long>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repos): how many owners and repositories hold a value, nulls counting as one."""
    held = scanned.select("owner", "repo", F.explode("found.value_hash").alias("value_hash"))
    return (
        held.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    )


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, n_owners, n_repos, live>>) of every row.

    ``live``: the value has fewer than ``copied_owners`` owners and is in fewer than ``copied_repos`` repositories.
    """
    scanned = materialise(scan(docs, owner_col, repo_col))
    # rows without candidates need nothing from the corpus
    full = scanned.where("size(found) > 0").withColumn("row", F.monotonically_increasing_id())
    hits = full.select("row", "doc_id", F.inline("found"))
    known = hits.join(ownership(scanned), "value_hash")
    live = (F.col("n_owners") < copied_owners) & (F.col("n_repos") < copied_repos)
    span = F.struct("start", "kind", "end", "n_owners", "n_repos", live.alias("live"))
    spans = known.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kept = F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])
    none = scanned.where("size(found) = 0").select("doc_id", F.array().cast("array<struct<start: long, kind: int, end: long, n_owners: long, n_repos: long, live: boolean>>").alias("spans"))
    return spans.select("doc_id", kept.alias("spans")).union(none)
