"""Recommended actions per assessed transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.fusion import with_families

# Title, action and priority of each recommendation (1 is most urgent).
PRIMARY = {
    "CRITICAL": (
        ("File Suspicious Activity Report", "FILE_SAR", 1),
        ("Freeze Transaction Pending Investigation", "FREEZE_ACCOUNT", 1),
    ),
    "VERY HIGH": (("Escalate to Compliance Team", "ESCALATE_TO_COMPLIANCE", 1),),
    "HIGH": (("Manual Investigator Review Required", "ESCALATE_TO_COMPLIANCE", 2),),
    "MEDIUM": (("Enhanced Due Diligence Required", "REQUEST_DOCUMENTS", 3),),
    "LOW": (("Continue Monitoring", "MONITOR_ACCOUNT", 4),),
}
SUPPLEMENTARY = {
    "pattern_findings": ("Refresh Customer KYC", "ENHANCED_DUE_DILIGENCE", 2),
    "statistical_findings": ("Review Historical Transactions", "MONITOR_ACCOUNT", 3),
    "behaviour_findings": ("Review Related Accounts", "MONITOR_ACCOUNT", 3),
    "ml_findings": ("Verify Source of Funds", "REQUEST_DOCUMENTS", 2),
}
SCORE_FLOOR = {"CRITICAL": 81.0, "VERY HIGH": 61.0, "HIGH": 41.0, "MEDIUM": 21.0}
INVESTIGATOR_STEP = {
    "FILE_SAR": "Prepare and submit the report to the financial intelligence unit within a day.",
    "FREEZE_ACCOUNT": "Hold the account, inform operations and note time and officer.",
    "ESCALATE_TO_COMPLIANCE": "Hand the case with its evidence to compliance and check the last 90 days.",
    "REQUEST_DOCUMENTS": "Ask the customer for source-of-funds documents.",
    "ENHANCED_DUE_DILIGENCE": "Verify identity and source of wealth again.",
    "MONITOR_ACCOUNT": "Keep watching; review history and linked accounts.",
}


def action(title: str, code: str, priority: int, position: int, reason: Column, triggered: Column) -> Column:
    """Priority and position come first, so sorting the structs is the stable order by priority."""
    return F.struct(
        F.lit(priority).alias("priority"),
        F.lit(position).alias("position"),
        F.lit(title).alias("title"),
        F.lit(code).alias("action"),
        reason.alias("reason"),
        F.lit(INVESTIGATOR_STEP[code]).alias("investigator_action"),
        triggered.alias("triggered_by"),
    )


def action_tier() -> Column:
    """Tier by level or by score, whichever is more severe."""
    level, score = F.upper("risk_level"), F.col("overall_risk_score")
    tier = F.lit("LOW")
    for name, floor in reversed(SCORE_FLOOR.items()):
        tier = F.when((level == name) | (score >= floor), name).otherwise(tier)
    return tier


def recommendations() -> Column:
    names = F.concat("triggered_rules", "triggered_patterns")
    none = F.array().cast("array<string>")
    why = F.concat_ws(
        " ", F.concat(F.lit("Risk score "), F.format_number("overall_risk_score", 1), F.lit(".")),
        F.when(F.size("top_reasons") > 0, F.array_join("top_reasons", "; ")),
    )
    offers, position = [], 0
    for tier, entries in PRIMARY.items():
        for title, code, priority in entries:
            triggered = none if tier == "LOW" else names
            offers.append(F.when(action_tier() == tier, action(title, code, priority, position, why, triggered)))
            position += 1
    for column, (title, code, priority) in SUPPLEMENTARY.items():
        triggered = F.transform(F.col(column), lambda f: f["name"])
        found = F.concat(F.size(column), F.lit(f" finding(s) in {column.split('_')[0]}."))
        offers.append(F.when(F.size(column) > 0, action(title, code, priority, position, found, triggered)))
        position += 1
    return F.array_sort(F.array_compact(F.array(*offers)))


def recommend(assessed: DataFrame) -> DataFrame:
    """Add ``recommendations``, most urgent first."""
    return with_families(assessed).withColumn("recommendations", recommendations())


def recommendations_long(assessed: DataFrame) -> DataFrame:
    return recommend(assessed).select("transaction_id", "customer_id", F.inline("recommendations"))
