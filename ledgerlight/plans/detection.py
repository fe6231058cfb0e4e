"""The batch detection run: features, detectors, fusion, explanation, actions and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.operators.actions import recommend
from ledgerlight.operators.alerts import prioritise, top_rows
from ledgerlight.operators.anomaly import AnomalyModel
from ledgerlight.operators.detectors import all_findings
from ledgerlight.operators.explain import explain
from ledgerlight.operators.features import build_features
from ledgerlight.operators.fusion import fuse
from ledgerlight.operators.ordered import Heat, find_heat
from ledgerlight.operators.profiles import build_profiles
from ledgerlight.session import materialise


def assess(
    transactions: DataFrame, profiles: DataFrame | None = None, cfg: EngineConfig = EngineConfig(),
    model: AnomalyModel | None = None, only: DataFrame | None = None, heat: Heat | None = None,
    featured: DataFrame | None = None,
) -> DataFrame:
    """Assessed transactions with at least one finding.

    ``only`` (transaction_id) narrows the answer after the features, which need whole histories, and
    before the detectors. ``heat`` are the customers with very many rows, found once for both steps; ``featured`` are the
    features, if they are worked out already.
    """
    if featured is None:
        heat = find_heat(transactions, "customer_id", cfg) if heat is None else heat
        profiles = build_profiles(transactions, cfg=cfg, heat=heat) if profiles is None else profiles
        featured = build_features(transactions, profiles, cfg, heat)
    if only is not None:
        featured = featured.join(only, "transaction_id", "left_semi")
    if model is not None:
        featured = model.transform(featured, cfg)
    return fuse(all_findings(featured, cfg), cfg)


RANKED = ("transaction_id", "customer_id", "overall_risk_score", "confidence_score", "risk_level")


def detect_alerts(
    transactions: DataFrame, profiles: DataFrame | None = None, cfg: EngineConfig = EngineConfig(),
    model: AnomalyModel | None = None,
) -> DataFrame:
    """Top alerts of a run, in two passes.

    The first ranks all transactions on five narrow columns; only those are shuffled for removing
    copies, and at most ``max_alerts`` rows remain. The second works out findings, texts and actions
    for the customers of these rows alone. Hot customers and profiles (one row each) are worked out once for both.
    """
    heat = find_heat(transactions, "customer_id", cfg)
    profiles = materialise(build_profiles(transactions, cfg=cfg, heat=heat)) if profiles is None else profiles
    scores = assess(transactions, profiles, cfg, model, heat=heat).select(*RANKED)
    if cfg.max_alerts > cfg.broadcast_rows:
        raise ValueError("more alerts than broadcast_rows allows; use investigate() for all alerts")
    winners = materialise(top_rows(scores, cfg))
    ids = F.broadcast(winners.select("transaction_id").distinct())
    # a transaction without a customer can win too
    owners = F.broadcast(winners.select(F.col("customer_id").alias("_owner")).distinct())
    rows = transactions.join(owners, F.expr("customer_id <=> _owner"), "left_semi")
    history = profiles.join(owners, F.expr("customer_id <=> _owner"), "left_semi")
    return prioritise(recommend(explain(assess(rows, history, cfg, model, ids, heat))), cfg)


def investigate(
    transactions: DataFrame, customers: DataFrame | None = None, transaction_ids: DataFrame | None = None,
    cfg: EngineConfig = EngineConfig(), limit: int | None = None,
) -> DataFrame:
    """The same run for chosen customers or transactions, given as one-column frames; all alerts unless ``limit`` is given.

    The customers' whole histories are read, since features look back; only the answer is narrowed.
    """
    rows, ids = transactions, None
    if transaction_ids is not None:
        ids = transaction_ids.select("transaction_id").distinct()
        owners = transactions.join(ids, "transaction_id", "left_semi").select("customer_id").distinct()
        customers = owners if customers is None else customers.select("customer_id").intersect(owners)
    if customers is not None:
        chosen = customers.select(F.col("customer_id").alias("_chosen")).distinct()
        rows = transactions.join(chosen, F.expr("customer_id <=> _chosen"), "left_semi")
    return prioritise(recommend(explain(assess(rows, cfg=cfg, only=ids))), cfg, limit=limit)


def filter_by_date(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Inclusive date range as plain comparisons, which reach the Parquet scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return df
