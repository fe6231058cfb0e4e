"""Ranked alerts from assessed transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig

# Priority names and the mapping from the four-level risk scale.
PRIORITIES = ("P1_CRITICAL", "P2_HIGH", "P3_MEDIUM", "P4_LOW")
LEVEL_PRIORITY = {"CRITICAL": "P1_CRITICAL", "HIGH": "P2_HIGH", "MEDIUM": "P3_MEDIUM", "LOW": "P4_LOW"}


def priority_from_score(score: Column, cfg: EngineConfig) -> Column:
    critical, high, medium = cfg.alert_thresholds
    p1, p2, p3, p4 = PRIORITIES
    return F.when(score >= critical, p1).when(score >= high, p2).when(score >= medium, p3).otherwise(p4)


def priority_from_level(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, priority in LEVEL_PRIORITY.items():
        out = F.when(F.upper(level) == name, priority).otherwise(out)
    return out


def plural(count: Column, noun: str, verb: str) -> Column:
    word = F.when(count > 1, noun + "s").otherwise(noun)
    return F.when(count > 0, F.concat(count, F.lit(" "), word, F.lit(" " + verb)))


def alert_title() -> Column:
    return F.concat_ws(
        " | ",
        F.concat(F.upper("risk_level"), F.lit(" Risk")),
        plural(F.size("triggered_rules"), "Rule", "Triggered"),
        plural(F.size("triggered_patterns"), "Pattern", "Matched"),
    )


def alert_summary() -> Column:
    first = F.slice("top_reasons", 1, 3)
    return F.concat_ws(
        " ",
        F.concat(
            F.lit("Transaction "), F.col("transaction_id").cast("string"), F.lit(": "), F.upper("risk_level"),
            F.lit(", score "), F.format_number("overall_risk_score", 1), F.lit("."),
        ),
        F.when(F.size(first) > 0, F.concat(F.lit("Reasons: "), F.array_join(first, "; "), F.lit("."))),
        plural(F.size("triggered_rules"), "rule", "triggered."),
        plural(F.size("triggered_patterns"), "pattern", "matched."),
    )


def one_per_transaction(df: DataFrame) -> DataFrame:
    """Best row of each transaction; rows without an id are skipped.

    An aggregate combines copies before the shuffle, so many copies of one id do no harm; the list
    columns go along in a struct of their own, which is left out where only the ranked ones are used.
    Ties are settled by confidence and level.
    """
    keyed = df.where(F.col("transaction_id").isNotNull() & (F.col("transaction_id").cast("string") != ""))
    ranked = ("overall_risk_score", "confidence_score", "customer_id", "risk_level")
    rest = [c for c in df.columns if c not in ("transaction_id", *ranked)]
    rank = F.struct(*ranked)
    rows = [F.max_by(F.struct(*rest), rank).alias("_row")] if rest else []
    best = keyed.groupBy("transaction_id").agg(F.max(rank).alias("_rank"), *rows)
    kept = [F.col(f"_rank.{c}" if c in ranked else f"_row.{c}").alias(c) for c in df.columns if c != "transaction_id"]
    return best.select("transaction_id", *kept)


#: What alerts are made of; the features and findings behind it are not carried along.
ASSESSED = (
    "transaction_id", "customer_id", "overall_risk_score", "confidence_score", "risk_level", "triggered_rules", "triggered_patterns",
    "top_reasons", "recommendations", "narrative", "contributing_factors",
)


def build_alerts(assessed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Unranked alerts: priority, title, summary, primary action and a stable id."""
    top = F.get(F.col("recommendations"), F.lit(0))
    return one_per_transaction(assessed.select(*ASSESSED)).select(
        F.concat(F.lit("ALT-"), F.hex(F.xxhash64(F.col("transaction_id").cast("string")))).alias("alert_id"),
        "transaction_id",
        "customer_id",
        priority_from_score(F.col("overall_risk_score"), cfg).alias("priority"),
        "risk_level",
        F.col("overall_risk_score").alias("fused_risk_score"),
        "confidence_score",
        alert_title().alias("alert_title"),
        alert_summary().alias("alert_summary"),
        F.coalesce(top["action"], F.lit("")).alias("recommended_action"),
        F.coalesce(top["investigator_action"], F.lit("")).alias("investigator_action"),
        "narrative",
        "contributing_factors",
        "triggered_rules",
        F.col("triggered_patterns").alias("matched_patterns"),
        "top_reasons",
        "recommendations",
        F.lit("OPEN").alias("status"),
    )


def alert_order() -> list[Column]:
    """Priority, then score and confidence falling, then transaction id."""
    return [
        F.col("priority").asc(), F.col("fused_risk_score").desc(), F.col("confidence_score").desc(),
        F.col("transaction_id").asc(),
    ]


def top_rows(assessed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The assessed rows that become the ``max_alerts`` most urgent alerts."""
    score = F.col("overall_risk_score")
    return (
        one_per_transaction(assessed)
        .withColumn("_priority", priority_from_score(score, cfg))
        .orderBy("_priority", score.desc(), F.col("confidence_score").desc(), "transaction_id")
        .limit(cfg.max_alerts)
        .drop("_priority")
    )


def prioritise(assessed: DataFrame, cfg: EngineConfig = EngineConfig(), limit: int | None = -1) -> DataFrame:
    """The most urgent alerts, a top-k of ``max_alerts`` (or ``limit``) rows; all in order if ``limit`` is None."""
    ordered = build_alerts(assessed, cfg).orderBy(*alert_order())
    return ordered if limit is None else ordered.limit(cfg.max_alerts if limit < 0 else limit)
