"""Isolation forest: many small trees built in parallel tasks, kept as a table of nodes.

Every draw (which rows a tree sees, a node's feature and cut) is a digest of seed, tree and node, and features are compared
as whole numbers, so the same trees grow wherever the rule is followed, in SQL too. A tree sees at most ``tree_sample`` rows
(the method's own sub-sampling), so a group handed to Python has a fixed size whatever the table holds. Scoring reads the
nodes as a small constant and works on Arrow batches; the cut is an exact quantile found without gathering the scores.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.operators.ordered import exact_quantiles
from ledgerlight.session import materialise

# The numeric features of the model.
FEATURES = (
    "amount_z_score", "amount_ratio_to_average", "transactions_last_hour", "transactions_last_day",
    "rolling_average_amount", "rolling_std_amount", "behaviour_deviation_score", "frequency_deviation_score",
    "time_since_previous_transaction", "beneficiary_frequency", "device_frequency", "channel_frequency",
    "country_frequency", "historical_average_amount", "historical_max_amount", "historical_min_amount",
)
MODEL_NAME = "IsolationForest_v1"
#: Node 1 is the root, the children of n are 2n (up to the threshold) and 2n + 1; a leaf has feature -1.
NODES = "tree int, node int, feature int, threshold long, path double"
#: Features are compared in units of 1 / UNITS; the offset keeps halves of a unit, frequent among averages, off the border.
UNITS, OFFSET, WIDEST = 10_000, 0.3717, 9e15
#: Scores are told apart in billionths.
DIGITS = 9


def finite(name: str) -> Column:
    """Null, NaN and infinities become 0."""
    c = F.col(name).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(c)


def whole(name: str) -> Column:
    """The feature as a whole number of units."""
    x = F.floor(finite(name) * UNITS + OFFSET)
    return F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), x.cast("double"))).cast("long")


def feature_array(features: tuple[str, ...] = FEATURES) -> Column:
    return F.array(*[whole(f) for f in features])


def scaling(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Mean and population deviation of each feature; trees do not depend on scale, reports show it."""
    row = df.agg(*[F.struct(F.avg(finite(f)).alias("mean"), F.stddev_pop(finite(f)).alias("std")).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f)["mean"].alias("mean"), F.col(f)["std"].alias("std")) for f in features])
    return row.select(F.inline(pairs))


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def passes(rows: int, cfg: EngineConfig) -> tuple[int, int]:
    """How many trees share one random order of ``rows``, and how many orders that takes."""
    shared = min(cfg.trees, max(1, rows // cfg.tree_sample))
    return shared, -(-cfg.trees // shared)


def tree_samples(df: DataFrame, rows: int, cfg: EngineConfig, features: tuple[str, ...]) -> DataFrame:
    """(tree, x): ``tree_sample`` rows for every tree, each a random set without repetition.

    The digests of (seed, pass, id) put the rows in a random order; consecutive runs of it are the samples of consecutive
    trees. One order, hence one digest a row, serves as many trees as the table has runs; a table too small for all trees
    takes further passes with orders of their own. Only the head of an order is kept (all but a chance below 1e-9 of
    missing any of it), so what is ranked is bounded by the settings.
    """
    shared, orders = passes(rows, cfg)
    wanted = shared * cfg.tree_sample
    share = min(1.0, (wanted + 6.0 * math.sqrt(wanted) + 20.0) / max(rows, 1))
    # digests are hex text, so their order is that of their leading digits
    bound = f"{min(int(share * 16**12), 16**12 - 1):012x}"
    ident = F.col("transaction_id").cast("string")
    draws = F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda p: F.struct(p.alias("_pass"), F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), p.cast("string"), ident)).alias("_draw")))
    heads = draws if share >= 1.0 else F.filter(draws, lambda d: d["_draw"] <= bound)
    spread = df.select(ident.alias("_id"), feature_array(features).alias("x"), F.inline(heads))
    rank = F.row_number().over(Window.partitionBy("_pass").orderBy("_draw", "_id", "x")) - 1
    placed = spread.withColumn("_run", F.floor(rank / cfg.tree_sample)).where(F.col("_run") < shared)
    tree = (F.col("_pass") * shared + F.col("_run")).cast("int")
    return placed.select(tree.alias("tree"), "x").where(F.col("tree") < cfg.trees)


def node_draw(seed: int, tree: int, node: int) -> tuple[int, int]:
    """Two 32-bit draws of a node: for its feature and for its cut."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """One tree: drawn feature, drawn threshold between its extremes, until the depth limit or a single point."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    rows: list[tuple] = []
    work = [(1, np.arange(len(x)), 0)]
    while work:
        node, members, depth = work.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(varied) == 0:
            rows.append((tree, node, -1, 0, depth + average_path(len(members))))
            continue
        which, where = node_draw(seed, tree, node)
        f = int(varied[which % len(varied)])
        cut = int(low[f]) + ((int(high[f]) - int(low[f])) * where >> 32)
        rows.append((tree, node, f, cut, 0.0))
        left = part[:, f] <= cut
        work += [(2 * node, members[left], depth + 1), (2 * node + 1, members[~left], depth + 1)]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "path"])


@dataclass(frozen=True)
class AnomalyModel:
    """Nodes (at most 2 * tree_sample per tree) and the cut score."""

    nodes: pd.DataFrame
    sample: int
    cut: float
    features: tuple[str, ...] = FEATURES

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``isolation_score`` in (0, 1), larger for rows that are easier to isolate."""
        size = 1 << int(self.nodes["node"].max()).bit_length()
        trees = []
        for _, g in self.nodes.sort_values("tree").groupby("tree"):
            feature, threshold, path = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            feature[g["node"]], threshold[g["node"]], path[g["node"]] = g["feature"], g["threshold"], g["path"]
            trees.append((feature, threshold, path))
        norm, width = average_path(self.sample), len(self.features)

        @F.pandas_udf("double")
        def isolation(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                x = np.vstack(xs.to_numpy()) if len(xs) else np.empty((0, width), np.int64)
                total = np.zeros(len(x))
                for feature, threshold, path in trees:
                    at = np.ones(len(x), dtype=int)
                    inner = np.flatnonzero(feature[at] >= 0)
                    while len(inner):
                        here = at[inner]
                        at[inner] = 2 * here + (x[inner, feature[here]] > threshold[here])
                        inner = inner[feature[at[inner]] >= 0]
                    total += path[at]
                # all points alike or a single one: no path, no anomaly
                yield pd.Series(2.0 ** (-total / max(len(trees), 1) / (norm or 1.0)))

        return df.withColumn("isolation_score", F.round(isolation(feature_array(self.features)), DIGITS))

    def transform(self, df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
        """Score all rows and attach ``ml_findings`` to the anomalies."""
        return with_findings(self.score(df), self.cut)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the trees as a Parquet table of nodes."""
        table = spark.createDataFrame(self.nodes, NODES)
        meta = {"sample": self.sample, "cut": self.cut}
        table.withColumns({k: F.lit(v) for k, v in meta.items()}).withColumn(
            "features", F.lit(",".join(self.features))
        ).write.mode("overwrite").parquet(path)


def with_findings(scored: DataFrame, cut: float) -> DataFrame:
    over = F.round(F.col("isolation_score") - F.lit(cut), DIGITS)
    confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2.0 * over)), 2)
    code = F.concat(F.lit("ML-"), F.upper(F.substring(F.md5(F.col("transaction_id").cast("string")), 1, 16)))
    found = F.struct(
        code.alias("id"), F.lit(MODEL_NAME).alias("name"), F.lit("HIGH").alias("severity"), over.alias("score"),
        confidence.alias("confidence"), over.alias("deviation"),
        F.concat(F.lit("isolation score "), F.format_number(over, 3), F.lit(" above the cut")).alias("reason"),
        F.create_map(F.lit("isolation_score"), F.col("isolation_score").cast("string")).alias("evidence"),
    )
    return scored.withColumns({"anomaly_score": over, "ml_findings": F.array_compact(F.array(F.when(over > 0, found)))})


def fit(df: DataFrame, cfg: EngineConfig = EngineConfig(), features: tuple[str, ...] = FEATURES) -> AnomalyModel:
    """Fit on a frame of features. The nodes that reach the driver are bounded by the tree settings."""
    # the rows are counted, sampled and scored, so their features are worked out and saved once
    saved = materialise(df.select("transaction_id", *features))
    rows = saved.count()
    if rows == 0:
        raise ValueError("no rows to fit the anomaly model on")
    seed = cfg.seed

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return grow(int(key[0]), np.vstack(pdf["x"].to_numpy()), seed)

    samples = tree_samples(saved, rows, cfg, features)
    nodes = samples.groupBy("tree").applyInPandas(build, NODES).toPandas()
    sample = min(cfg.tree_sample, rows)
    draft = AnomalyModel(nodes, sample, 0.0, features)
    scores = materialise(draft.score(saved).select("isolation_score"))
    row = exact_quantiles(scores, [], "isolation_score", {"cut": 1.0 - cfg.contamination}, cfg).first()
    return AnomalyModel(nodes, sample, float(row.cut), features)


def load(spark: SparkSession, path: str) -> AnomalyModel:
    saved = spark.read.parquet(path)
    first = saved.select("sample", "cut", "features").first()
    nodes = saved.drop("sample", "cut", "features").toPandas()
    return AnomalyModel(nodes, int(first["sample"]), float(first["cut"]), tuple(first["features"].split(",")))


def fit_or_load(df: DataFrame, path: str, cfg: EngineConfig = EngineConfig()) -> AnomalyModel:
    """The saved model if there is one, otherwise a new one that is saved."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    try:
        return load(spark, path)
    except AnalysisException:
        model = fit(df, cfg)
        model.save(spark, path)
        return model
