"""Mixing sources to target weights by balanced sampling (cube method).

Targets: sources in code point order (null last) get repeating weights; together they take ``share`` of all words, and none
more than ``cap`` times its own size, the excess going to the others by weight. Every document of a source is taken the
whole times its ratio target/size allows, and once more with the ratio's fractional part as inclusion probability.

The cube method settles those fractions: probabilities move along the null space of the constraints (document total and
word total of the source) until one of them is 0 or 1, so both totals stay as they are. The flight runs in blocks of a
source in parallel, each of which leaves two documents unsettled; those of many blocks fly on together, and the last two of
a source are landed with ten others: of their few samples, one of those that come closest to both totals. A hot source is many blocks; blocks come from hashes of the rows, so reruns agree.

Null texts have size 0; rows keep their null ids and sources (a null source is one of its own). Repeated rows are sampled
one by one, in one block. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of one flight.
BLOCK = 4096
#: Units that wait for the landing of a source.
LANDING = 10
SEED = 20_240


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size): words of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, docs, target): one row for each source; the windows order sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.row_number().over(order) - 1) % len(weights) + 1
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per = per.withColumn("weight", F.element_at(cycle, place.cast("int"))).withColumn("full", F.col("source_size") * cap)
    ratio = F.col("full") / F.col("weight")
    everything = Window.partitionBy()
    below = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # sources fill up in the order of full/weight; the level is that of the first one that is not full
    level = per.withColumns({
        "ratio": ratio,
        "level": (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("full").over(below), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))),
    }).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return level.select("source", "source_size", "docs", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move probabilities to 0 or 1 with their sum and their size-weighted sum unchanged; at most two stay fractional.

    ``land``: settle all. Some units of all sizes stay out of the flight; they and the last two are landed together.
    """
    chance = chance.astype(float)
    draws = iter(rng.random(len(chance) + 8).tolist())
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    last = open_[np.unique(np.linspace(0, len(open_) - 1, min(LANDING, len(open_))).astype(int))] if land else open_[:0]
    words = float((size[open_] * chance[open_]).sum())
    total = float(chance[open_].sum())
    held: list[int] = []
    for i in np.setdiff1d(open_, last, assume_unique=True).tolist():
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (float(size[k]) for k in held)
        along = [c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0]
        forth = min(((1 - chance[k]) if u > 0 else chance[k]) / abs(u) for k, u in zip(held, along) if u)
        back = min((chance[k] if u > 0 else (1 - chance[k])) / abs(u) for k, u in zip(held, along) if u)
        step = forth if next(draws) * (forth + back) < back else -back
        for k, u in zip(held, along):
            q = chance[k] + step * u
            chance[k] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        held = [k for k in held if 0 < chance[k] < 1]
    last = np.concatenate([last, np.array(held, int)]) if land else last
    if len(last):
        settled = np.setdiff1d(open_, last, assume_unique=True)
        chance[last] = _landed(
            size[last].astype(float), chance[last], words - float((size[settled] * chance[settled]).sum()), total - float(chance[settled].sum()), rng
        )
    return chance


def _landed(size: np.ndarray, chance: np.ndarray, words: float, total: float, rng: np.random.Generator) -> np.ndarray:
    """A sample of a few units close to both totals, drawn by the units' own probabilities among the samples as close."""
    samples = (np.arange(1 << len(size))[:, None] >> np.arange(len(size)) & 1).astype(float)
    gap = np.abs(samples @ size - words) / max(1.0, float(size.mean())) + 0.1 * np.maximum(0.0, np.abs(samples.sum(1) - total) - 1)
    good = np.flatnonzero(gap <= gap.min() + 0.01)
    weight = np.where(samples[good] > 0, chance, 1 - chance).prod(1)
    return samples[rng.choice(good, p=weight / weight.sum() if weight.sum() > 0 else None)]


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, times): how often the mix takes every document."""
    sized = materialise(sizes(docs))
    goal = targets(sized, share, cap, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(goal.withColumnRenamed("source", "_source"), F.expr("source <=> _source")).drop("_source")
    rows = rows.withColumn("base", F.floor(ratio + 1e-12).cast("long")).withColumn("chance", F.greatest(F.lit(0.0), ratio - F.col("base")))
    rows = rows.withColumn("spot", F.xxhash64("doc_id", "text_key", F.lit(SEED)))
    order = ["spot", "doc_id", "text_key"]

    def fly(land: bool):
        def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            # by size: units of all sizes wait for the landing
            own = own.sort_values(["size", *order], ascending=[False, True, True, True], kind="stable", na_position="first", ignore_index=True)
            low = int(own["spot"].iloc[0]) & 0xFFFFFFFF
            own["chance"] = flight(own["size"].to_numpy(), own["chance"].to_numpy(), np.random.default_rng([SEED, low, len(own)]), land)
            return own

        return run

    settled, level = None, 0
    columns = [c for c in rows.columns]
    while True:
        most = rows.where("chance > 0 AND chance < 1").groupBy("source").count().agg(F.max("count")).first()[0] or 0
        land = most <= block
        # one block where all unsettled rows of every source fit; else by the source's own number of rows
        parts = F.lit(1) if land else F.greatest(F.lit(1), F.ceil(F.col("docs") / (block * (block // 4) ** level)))
        dealt = rows.withColumn("block", F.pmod(F.shiftright("spot", 7), parts))
        flown = materialise(dealt.groupBy("source", "block").applyInPandas(fly(land), dealt.schema).select(*columns))
        done = flown if land else flown.where("chance <= 0 OR chance >= 1")
        settled = done if settled is None else settled.union(done)
        if land:
            break
        rows, level = flown.where("chance > 0 AND chance < 1"), level + 1
    return settled.select("doc_id", "text_key", "source", "size", "source_size", "target", (F.col("base") + F.round("chance").cast("long")).alias("times"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document that is taken twice is two rows, one that is not taken is none."""
    taken = mix(docs, **options).where("times > 0")
    units = taken.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source")).agg(
        F.sum("times").alias("_sum"), F.count("*").alias("_rows")
    )
    # repeated rows share their takes; the first of them get one more where these do not divide evenly
    units = materialise(units)
    same = F.expr("doc_id <=> _id AND xxhash64(coalesce(text, '')) = _key AND source <=> _source")
    times = F.expr("sequence(1, cast(_sum AS int))")
    single = docs.join(units.where("_rows = 1"), same).withColumn("_copy", F.explode(times)).select(*docs.columns)
    many = units.where("_rows > 1")
    if not many.take(1):
        return single
    order = Window.partitionBy("doc_id", "_key", "source").orderBy(*docs.columns)
    again = docs.join(many, same).withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return single.union(again.withColumn("_copy", F.explode(times)).select(*docs.columns))
