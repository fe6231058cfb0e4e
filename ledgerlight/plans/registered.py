"""Registered queries over the driver tables, each next to the SQL it has to agree with.

The trees of the anomaly model are grown by recursive SQL from the same digests. ``sql=None`` would mark work SQL cannot express.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.functions.timeparts import with_time_parts
from ledgerlight.operators import (
    actions,
    alerts,
    anomaly,
    cleaning,
    detectors,
    enrichment,
    explain,
    features,
    fusion,
    ordered,
    profiles,
    quality,
    reports,
    triage,
    typologies,
)
from ledgerlight.operators.ordered import find_heat
from ledgerlight.plans import detection
from ledgerlight.plans import oracle_parts as O
from ledgerlight.session import materialise
from ledgerlight.sources import driver_views as views

Query = Callable[[SparkSession, str], DataFrame]
CFG = EngineConfig()


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None):
    def keep(run: Query) -> Query:
        REGISTRY[name] = Registered(run, sql)
        return run

    return keep


# Halves of a unit are frequent among averages of cents; the shift makes both engines round them up.
SHIFT = 1e-7


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double") + SHIFT, digits) for c in columns})


def rd(expression: str, digits: int, name: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {SHIFT}, {digits}) AS {name or expression}"


def rounds(digits: int, *columns: str) -> str:
    return ", ".join(rd(c, digits) for c in columns)


# --- profiles ------------------------------------------------------------------------------------------

STATS4 = (
    "avg_amount", "median_amount", "max_amount", "min_amount", "std_amount", "avg_daily_txns", "avg_weekly_txns",
    "avg_monthly_txns", "avg_txn_gap_days", "business_hours_ratio", "weekend_ratio",
)
STATS = (
    "total_txns", "preferred_hour", "most_active_weekday", "most_active_month", "unique_devices", "unique_channels",
    "unique_beneficiaries", "unique_countries", "most_common_channel", "most_common_txn_type", "active_days",
)


@register("customer_profile", f"""WITH {O.EV}, {O.profile(device=True)}
SELECT customer_id, {rounds(4, *STATS4)}, {', '.join(STATS)} FROM p""")
def customer_profile(spark, d):
    built = profiles.build_profiles(views.txn_events(spark, d))
    flat = built.select("customer_id", *[F.col(f"statistics.{c}").alias(c) for c in (*STATS4, *STATS)])
    return rounded(flat, 4, *STATS4)


@register("counterparty_profile", f"""WITH {O.LINES}, {O.profile(party=True)},
{O.mode_cte('pb', 'counterparty_account_id', 'most_common_beneficiary')}
SELECT customer_id, {rounds(3, *STATS4)}, {', '.join(STATS)}, CAST(most_common_beneficiary AS VARCHAR) AS most_common_beneficiary
FROM p JOIN pb USING (customer_id)""")
def counterparty_profile(spark, d):
    built = profiles.build_profiles(views.txn_lines(spark, d))
    names = (*STATS4, *STATS, "most_common_beneficiary")
    return rounded(built.select("customer_id", *[F.col(f"statistics.{c}").alias(c) for c in names]), 3, *STATS4)


@register("hot_customer_profile", f"""WITH {O.EV}, {O.profile(device=True)}
SELECT customer_id, {rounds(4, *STATS4)}, {', '.join(STATS)} FROM p""")
def hot_customer_profile(spark, d):
    """Every customer is hot at this limit: the way of counts and slices over the whole table."""
    built = profiles.build_profiles(views.txn_events(spark, d), cfg=EngineConfig(hot_key_rows=50, slice_rows=5000))
    flat = built.select("customer_id", *[F.col(f"statistics.{c}").alias(c) for c in (*STATS4, *STATS)])
    return rounded(flat, 4, *STATS4)


@register("hot_velocity_features", f"""WITH {O.events_features()}
SELECT transaction_id, {rd('gap', 4, 'time_since_previous_transaction')}, {rd('amount_last_day', 4, 'amount_last_day')}, {rd('rolling_average_amount', 4, 'rolling_average_amount')},
  {rd('rolling_std_amount', 4, 'rolling_std_amount')}, transactions_last_hour, transactions_last_day, transactions_last_week FROM f""")
def hot_velocity_features(spark, d):
    """The same for trailing windows."""
    numbers = ("time_since_previous_transaction", "amount_last_day", "rolling_average_amount", "rolling_std_amount")
    rows = features.velocity_features(views.txn_events(spark, d), EngineConfig(hot_key_rows=50, slice_rows=5000))
    return rounded(rows.select("transaction_id", *numbers, "transactions_last_hour", "transactions_last_day", "transactions_last_week"), 4, *numbers)


CONFIDENCE = """round(least(total_txns / 50.0, 1) * 0.5 + 0.1 * 0.3
  + (CASE WHEN avg_amount > 0 THEN greatest(0.0, least(1.0, 1 - std_amount / avg_amount / 3)) ELSE 0.5 END) * 0.2, 2)"""


@register("profile_flags_confidence", f"""WITH {O.EV}, {O.profile(device=True)}
SELECT customer_id, false AS salary_account, unique_beneficiaries > 20 AND avg_monthly_txns > 50 AS business_account,
  avg_monthly_txns < 0.5 AS dormant_customer, avg_daily_txns > 3 AS high_activity_customer,
  business_hours_ratio < 0.2 AS night_activity_customer, weekend_ratio > 0.4 AS weekend_heavy_customer,
  unique_countries > 1 AS international_customer, most_common_channel IN ('click', 'view') AS digital_first_customer,
  {CONFIDENCE} AS confidence_score FROM p""")
def profile_flags_confidence(spark, d):
    cfg = EngineConfig(digital_channels=("click", "view"))
    built = profiles.build_profiles(views.txn_events(spark, d), cfg=cfg)
    flags = ("salary_account", "business_account", "dormant_customer", "high_activity_customer",
             "night_activity_customer", "weekend_heavy_customer", "international_customer", "digital_first_customer")
    return built.select("customer_id", *[F.col(f"flags.{c}").alias(c) for c in flags], "confidence_score")


@register("type_ratio_pivot", f"""WITH {O.EV}
SELECT customer_id, transaction_type, count(*) AS txns,
  {rd('count(*) / sum(count(*)) OVER (PARTITION BY customer_id)', 6, 'ratio')} FROM v GROUP BY customer_id, transaction_type""")
def type_ratio_pivot(spark, d):
    return rounded(profiles.type_ratio_table(views.txn_events(spark, d)), 6, "ratio")


@register("cash_and_transfer_ratios", f"""WITH {O.EV}
SELECT customer_id, {rd("count(*) FILTER (transaction_type = 'purchase') / count(*)", 6, 'cash_withdrawal_ratio')},
  {rd("count(*) FILTER (transaction_type IN ('signup', 'view')) / count(*)", 6, 'deposit_ratio')},
  {rd("count(*) FILTER (transaction_type = 'click') / count(*)", 6, 'transfer_ratio')} FROM v GROUP BY customer_id""")
def cash_and_transfer_ratios(spark, d):
    cfg = EngineConfig(cash_types=("purchase",), deposit_types=("signup", "view"), transfer_types=("click",))
    names = ("cash_withdrawal_ratio", "deposit_ratio", "transfer_ratio")
    stats = profiles.profile_statistics(views.txn_events(spark, d), cfg)
    return rounded(stats.select("customer_id", *names), 6, *names)


# --- features -------------------------------------------------------------------------------------------

AMOUNT = ("customer_average_amount", "customer_median_amount", "customer_std_amount", "amount_difference",
          "amount_ratio_to_average", "amount_z_score", "amount_percentile")


@register("amount_features", f"""WITH {O.events_features()}
SELECT transaction_id, {rd('avg_amount', 4, 'customer_average_amount')}, {rd('median_amount', 4, 'customer_median_amount')},
  {rd('std_amount', 4, 'customer_std_amount')}, {rd('amount_difference', 4, 'amount_difference')},
  {rd('amount_ratio', 4, 'amount_ratio_to_average')}, {rd('z', 4, 'amount_z_score')},
  {rd('amount_percentile', 4, 'amount_percentile')}, large AS large_transaction_flag FROM f""")
def amount_features(spark, d):
    rows = features.amount_features(views.txn_events(spark, d))
    return rounded(rows.select("transaction_id", *AMOUNT, "large_transaction_flag"), 4, *AMOUNT)


VELOCITY = ("time_since_previous_transaction", "amount_last_day", "amount_last_week", "rolling_average_amount",
            "rolling_std_amount", "average_gap_between_transactions")
COUNTS = ("transactions_last_hour", "transactions_last_day", "transactions_last_week")


@register("velocity_features", f"""WITH {O.events_features()}
SELECT transaction_id, {rd('gap', 4, 'time_since_previous_transaction')}, {rounds(4, 'amount_last_day', 'amount_last_week',
  'rolling_average_amount', 'rolling_std_amount')}, {rd('average_gap', 4, 'average_gap_between_transactions')},
  {', '.join(COUNTS)} FROM f""")
def velocity_features(spark, d):
    rows = features.velocity_features(views.txn_events(spark, d))
    return rounded(rows.select("transaction_id", *VELOCITY, *COUNTS), 4, *VELOCITY)


@register("velocity_features_dates", f"""WITH {O.ORDERS}
SELECT transaction_id, count(*) OVER w AS transactions_last_week, {rd('sum(amount) OVER w', 2, 'amount_last_week')}
FROM v WINDOW w AS (PARTITION BY customer_id ORDER BY ts {O.back(O.WEEK)})""")
def velocity_features_dates(spark, d):
    rows = features.velocity_features(views.txn_orders(spark, d))
    return rounded(rows.select("transaction_id", "transactions_last_week", "amount_last_week"), 2, "amount_last_week")


def with_history(rows: DataFrame) -> DataFrame:
    """Features with the profiles of the same rows; customers are counted once for both, and both read one exchange."""
    heat = find_heat(rows, "customer_id", EngineConfig())
    return features.build_features(rows, profiles.build_profiles(rows, heat=heat, shared=True), heat=heat, shared=True)


def events_with_profiles(spark, d) -> DataFrame:
    return with_history(views.txn_events(spark, d))


def lines_with_profiles(spark, d) -> DataFrame:
    # no feature reads the merchant, so it is not dealt with the rows
    return with_history(views.txn_lines(spark, d).drop("merchant_id"))


@register("behaviour_deviation", f"""WITH {O.events_features()}
SELECT transaction_id, outside_hours AS outside_business_hours, off_hour AS outside_preferred_hour,
  off_weekday AS unusual_weekday, off_month AS unusual_month, {rd('amount_dev', 4, 'amount_deviation_score')},
  {rd('freq_dev', 4, 'frequency_deviation_score')}, {rd('deviation', 4, 'behaviour_deviation_score')} FROM f""")
def behaviour_deviation(spark, d):
    scores = ("amount_deviation_score", "frequency_deviation_score", "behaviour_deviation_score")
    rows = events_with_profiles(spark, d).select(
        "transaction_id", "outside_business_hours", "outside_preferred_hour", "unusual_weekday", "unusual_month", *scores
    )
    return rounded(rows, 4, *scores)


@register("device_features", f"""WITH {O.events_features()}
SELECT transaction_id, new_device, device_frequency, device_switch_flag,
  CAST(unique_devices_last_30_days AS BIGINT) AS unique_devices_last_30_days FROM f""")
def device_features(spark, d):
    rows = features.pair_features(views.txn_events(spark, d))
    return rows.select("transaction_id", "new_device", "device_frequency", "device_switch_flag", "unique_devices_last_30_days")


@register("unique_devices_7d", f"""WITH {O.EV}
SELECT transaction_id, CAST(list_unique(list(device_id) OVER (PARTITION BY customer_id ORDER BY ts {O.back(O.WEEK)})) AS BIGINT) AS devices
FROM v""")
def unique_devices_7d(spark, d):
    rows = ordered.rolling_distinct(views.txn_events(spark, d), "customer_id", "device_id", O.WEEK, "devices", CFG)
    return rows.select("transaction_id", "devices")


@register("channel_features", f"""WITH {O.ORDERS}, {O.mode_cte('m', 'channel', 'preferred_channel')}
SELECT transaction_id, preferred_channel, channel <> preferred_channel AS outside_preferred_channel, n AS channel_frequency, n = 1 AS new_channel
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, channel ORDER BY ts, transaction_id) AS n FROM v) JOIN m USING (customer_id)""")
def channel_features(spark, d):
    rows = features.pair_features(views.txn_orders(spark, d))
    return rows.select("transaction_id", "preferred_channel", "outside_preferred_channel", "channel_frequency", "new_channel")


@register("counterparty_features", f"""WITH {O.LINES}, {O.profile(party=True)}, {O.features(party=True)}
SELECT transaction_id, new_beneficiary, beneficiary_frequency, beneficiary_transaction_count,
  {rd('beneficiary_amount_average', 2, 'beneficiary_amount_average')}, {rd('beneficiary_amount_std', 2, 'beneficiary_amount_std')},
  often AS beneficiary_is_high_frequency FROM f""")
def counterparty_features(spark, d):
    rows = features.pair_features(views.txn_lines(spark, d)).select(
        "transaction_id", "new_beneficiary", "beneficiary_frequency", "beneficiary_transaction_count",
        "beneficiary_amount_average", "beneficiary_amount_std", "beneficiary_is_high_frequency",
    )
    return rounded(rows, 2, "beneficiary_amount_average", "beneficiary_amount_std")


@register("geography_features", f"""WITH {O.LINES}, {O.profile(party=True)}, {O.features(party=True)}
SELECT transaction_id, new_country, country_frequency, geographic_change, cross_border_transaction,
  CASE WHEN geographic_change THEN 500.0 ELSE 0.0 END AS distance_from_previous_country FROM f""")
def geography_features(spark, d):
    return features.pair_features(views.txn_lines(spark, d)).select(
        "transaction_id", "new_country", "country_frequency", "geographic_change", "cross_border_transaction",
        "distance_from_previous_country",
    )


# --- detectors ----------------------------------------------------------------------------------------------


def long_findings(df: DataFrame, column: str) -> DataFrame:
    rows = detectors.findings_long(df, column)
    return rows.select("transaction_id", "id", "severity", "score", "confidence")


def findings_sql(source: str, family: str, name: str) -> str:
    return f"WITH {source}, {family} SELECT transaction_id, id, severity, score, confidence FROM {name}"


@register("rule_hits", findings_sql(O.events_features(), O.rules(), "r"))
def rule_hits(spark, d):
    return long_findings(detectors.rule_hits(events_with_profiles(spark, d)), "rule_hits")


@register("statistical_findings", findings_sql(O.events_features(), O.statistics(), "s"))
def statistical_findings(spark, d):
    return long_findings(detectors.statistical_findings(events_with_profiles(spark, d)), "statistical_findings")


@register("behaviour_findings", findings_sql(O.events_features(), O.behaviour(), "b"))
def behaviour_findings(spark, d):
    return long_findings(detectors.behaviour_findings(events_with_profiles(spark, d)), "behaviour_findings")


@register("pattern_findings", findings_sql(O.events_features(), O.patterns(), "t"))
def pattern_findings(spark, d):
    return long_findings(detectors.pattern_findings(events_with_profiles(spark, d)), "pattern_findings")


@register("rule_hits_counterparty", findings_sql(O.lines_features(), O.rules(), "r"))
def rule_hits_counterparty(spark, d):
    return long_findings(detectors.rule_hits(lines_with_profiles(spark, d)), "rule_hits")


@register("behaviour_findings_counterparty", findings_sql(O.lines_features(), O.behaviour(), "b"))
def behaviour_findings_counterparty(spark, d):
    return long_findings(detectors.behaviour_findings(lines_with_profiles(spark, d)), "behaviour_findings")


@register("pattern_findings_counterparty", findings_sql(O.lines_features(), O.patterns().replace(
    "UNION ALL SELECT transaction_id, 'P003'", "UNION ALL SELECT transaction_id, 'P002' AS id, 'Rapid Movement of Funds' AS name, "
    "'HIGH' AS severity, 0.0 AS score, 0.85 AS confidence FROM f WHERE false UNION ALL SELECT transaction_id, 'P003'"), "t"))
def pattern_findings_counterparty(spark, d):
    return long_findings(detectors.pattern_findings(lines_with_profiles(spark, d)), "pattern_findings")


@register("historical_range_as_of", f"""WITH {O.EV}, h AS (SELECT customer_id, max(amount) AS hi, min(amount) AS lo FROM v
  WHERE ts < TIMESTAMP '2024-01-16' GROUP BY customer_id)
SELECT transaction_id, CASE WHEN amount > hi THEN 'HIGH' ELSE 'LOW' END AS severity,
  CASE WHEN amount > hi THEN 85.0 ELSE 30.0 END AS score
FROM v JOIN h USING (customer_id) WHERE (hi > 0 AND amount > hi) OR (lo > 0 AND amount < lo)""")
def historical_range_as_of(spark, d):
    rows = views.txn_events(spark, d)
    history = profiles.build_profiles(rows, as_of="2024-01-16")
    found = detectors.statistical_findings(features.build_features(rows, history))
    long = detectors.findings_long(found, "statistical_findings")
    return long.where(F.col("id") == "S009").select("transaction_id", "severity", "score")


@register("round_amount_scenario", f"""WITH {O.ORDERS},
w AS (SELECT transaction_id, CASE WHEN transaction_type = 'F' THEN floor(amount / 1000) * 1000 ELSE amount END AS amount FROM v)
SELECT transaction_id, CAST(amount % 1000 = 0 AS INT) AS is_round_amount,
  CASE WHEN amount % 1000 = 0 THEN 50.0 ELSE 0.0 END AS round_amount_score FROM w""")
def round_amount_scenario(spark, d):
    # order totals are hardly ever round, so those of finished orders are rounded down first
    finished, amount = F.col("transaction_type") == "F", F.col("amount")
    shaped = views.txn_orders(spark, d).withColumn(
        "amount", F.when(finished, F.floor(amount / 1000) * 1000.0).otherwise(amount)
    )
    return detectors.round_amount_scenario(shaped).select("transaction_id", "is_round_amount", "round_amount_score")


@register("iqr_outliers", f"""WITH {O.EV}, q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM v)
SELECT transaction_id, amount FROM v, q WHERE amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a)""")
def iqr_outliers(spark, d):
    return detectors.iqr_outliers(views.txn_events(spark, d), "amount").select("transaction_id", "amount")


@register("iqr_outliers_by_channel", f"""WITH {O.EV}, q AS (SELECT channel, quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM v GROUP BY channel)
SELECT transaction_id, channel, amount FROM v JOIN q USING (channel) WHERE amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a)""")
def iqr_outliers_by_channel(spark, d):
    found = detectors.iqr_outliers(views.txn_events(spark, d), "amount", keys=["channel"])
    return found.select("transaction_id", "channel", "amount")


# --- fusion, explanation, actions, alerts ----------------------------------------------------------------------


@register("risk_fusion", f"""WITH {O.events_fused()}
SELECT transaction_id, overall_risk_score, confidence_score, risk_level, active_engines, rs AS rule_score,
  bs AS behaviour_score, ss AS statistical_score, ps AS pattern_score FROM fused""")
def risk_fusion(spark, d):
    rows = detection.assess(views.txn_events(spark, d))
    score = F.col("engine_scores")
    return rows.select(
        "transaction_id", "overall_risk_score", "confidence_score", "risk_level", "active_engines",
        score["Rule"].alias("rule_score"), score["Behaviour"].alias("behaviour_score"),
        score["Statistical"].alias("statistical_score"), score["Pattern"].alias("pattern_score"),
    )


REASONS = """
named AS (SELECT transaction_id, name, min(fam * 1000 + CAST(substr(id, 2) AS INT)) AS place FROM (
    SELECT *, 1 AS fam FROM r UNION ALL SELECT *, 2 FROM t UNION ALL SELECT *, 3 FROM b UNION ALL SELECT *, 4 FROM s)
  WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY transaction_id, name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY place) AS n FROM named),
reasons AS (SELECT transaction_id, string_agg(name, '; ' ORDER BY n) AS top_reasons FROM ranked WHERE n <= 5 GROUP BY transaction_id)"""


@register("top_reasons", f"""WITH {O.events_fused()}, {REASONS}
SELECT transaction_id, coalesce(top_reasons, '') AS top_reasons FROM fused LEFT JOIN reasons USING (transaction_id)""")
def top_reasons(spark, d):
    return detection.assess(views.txn_events(spark, d)).select(
        "transaction_id", F.array_join("top_reasons", "; ").alias("top_reasons")
    )


TIER = """CASE WHEN risk_level = 'CRITICAL' OR overall_risk_score >= 81 THEN 'CRITICAL'
  WHEN risk_level = 'VERY HIGH' OR overall_risk_score >= 61 THEN 'VERY HIGH' WHEN risk_level = 'HIGH' OR overall_risk_score >= 41 THEN 'HIGH'
  WHEN risk_level = 'MEDIUM' OR overall_risk_score >= 21 THEN 'MEDIUM' ELSE 'LOW' END"""


@register("recommendations", f"""WITH {O.events_fused()}, x AS (SELECT *, {TIER} AS tier FROM fused)
SELECT transaction_id, 1 AS priority, 'FILE_SAR' AS action, 'File Suspicious Activity Report' AS title FROM x WHERE tier = 'CRITICAL'
UNION ALL SELECT transaction_id, 1, 'FREEZE_ACCOUNT', 'Freeze Transaction Pending Investigation' FROM x WHERE tier = 'CRITICAL'
UNION ALL SELECT transaction_id, 1, 'ESCALATE_TO_COMPLIANCE', 'Escalate to Compliance Team' FROM x WHERE tier = 'VERY HIGH'
UNION ALL SELECT transaction_id, 2, 'ESCALATE_TO_COMPLIANCE', 'Manual Investigator Review Required' FROM x WHERE tier = 'HIGH'
UNION ALL SELECT transaction_id, 3, 'REQUEST_DOCUMENTS', 'Enhanced Due Diligence Required' FROM x WHERE tier = 'MEDIUM'
UNION ALL SELECT transaction_id, 4, 'MONITOR_ACCOUNT', 'Continue Monitoring' FROM x WHERE tier = 'LOW'
UNION ALL SELECT transaction_id, 2, 'ENHANCED_DUE_DILIGENCE', 'Refresh Customer KYC' FROM x WHERE pn > 0
UNION ALL SELECT transaction_id, 3, 'MONITOR_ACCOUNT', 'Review Historical Transactions' FROM x WHERE sn > 0
UNION ALL SELECT transaction_id, 3, 'MONITOR_ACCOUNT', 'Review Related Accounts' FROM x WHERE bn > 0""")
def recommendations(spark, d):
    long = actions.recommendations_long(detection.assess(views.txn_events(spark, d)))
    return long.select("transaction_id", "priority", "action", "title")


@register("contributing_factors", f"""WITH {O.events_features()}, {O.rules()}, {O.statistics()}, {O.behaviour()}, {O.patterns()}
SELECT transaction_id, 'rule' AS type, name, score FROM r UNION ALL SELECT transaction_id, 'behaviour', name, score FROM b
UNION ALL SELECT transaction_id, 'statistical', name, score FROM s UNION ALL SELECT transaction_id, 'pattern', name, confidence FROM t""")
def contributing_factors(spark, d):
    rows = explain.explain(detection.assess(views.txn_events(spark, d)))
    return rows.select("transaction_id", F.inline("contributing_factors"))


@register("narratives", f"""WITH {O.events_fused()}
SELECT transaction_id, concat('Classified as ', risk_level, ' RISK, score ', printf('%.2f', overall_risk_score), ', confidence ',
    printf('%.2f', confidence_score), '.') AS headline,
  concat(CASE WHEN active_engines >= 3 THEN 'High' WHEN active_engines = 2 THEN 'Moderate' ELSE 'Lower' END, ' confidence: ',
    active_engines, ' independent engine(s) agree.') AS agreement FROM fused""")
def narratives(spark, d):
    parts = F.split("narrative", "\n\n")
    rows = explain.explain(detection.assess(views.txn_events(spark, d)))
    return rows.select("transaction_id", F.get(parts, F.lit(0)).alias("headline"), F.get(parts, F.lit(3)).alias("agreement"))


PRIORITY = """CASE WHEN overall_risk_score >= 90 THEN 'P1_CRITICAL' WHEN overall_risk_score >= 75 THEN 'P2_HIGH'
  WHEN overall_risk_score >= 50 THEN 'P3_MEDIUM' ELSE 'P4_LOW' END"""
TITLE = """concat(risk_level, ' Risk', CASE WHEN rn > 1 THEN concat(' | ', rn, ' Rules Triggered') WHEN rn = 1 THEN ' | 1 Rule Triggered' ELSE '' END,
  CASE WHEN pn > 1 THEN concat(' | ', pn, ' Patterns Matched') WHEN pn = 1 THEN ' | 1 Pattern Matched' ELSE '' END)"""


@register("alert_topk", f"""WITH {O.events_fused()}
SELECT transaction_id, customer_id, {PRIORITY} AS priority, risk_level, overall_risk_score AS fused_risk_score, confidence_score, {TITLE} AS alert_title
FROM fused ORDER BY priority, overall_risk_score DESC, confidence_score DESC, transaction_id LIMIT 1000""")
def alert_topk(spark, d):
    return detection.detect_alerts(views.txn_events(spark, d)).select(
        "transaction_id", "customer_id", "priority", "risk_level", "fused_risk_score", "confidence_score", "alert_title"
    )


def all_alerts(spark, d) -> DataFrame:
    rows = actions.recommend(explain.explain(detection.assess(views.txn_events(spark, d))))
    return alerts.build_alerts(rows).select(
        "alert_id", "transaction_id", "customer_id", "priority", "risk_level", "fused_risk_score", "confidence_score", "status"
    )


@register("alert_priority_counts", f"""WITH {O.events_fused()}
SELECT {PRIORITY} AS priority, count(*) AS alerts FROM fused GROUP BY 1""")
def alert_priority_counts(spark, d):
    return all_alerts(spark, d).groupBy("priority").agg(F.count(F.lit(1)).alias("alerts"))


@register("alert_dedupe", f"""WITH {O.ORDERS}, x AS (SELECT customer_id AS transaction_id, amount / 10000 AS s, transaction_id AS o FROM v)
SELECT transaction_id, {rd('s', 6, 'overall_risk_score')}, source_order FROM (
  SELECT transaction_id, s, o AS source_order, row_number() OVER (PARTITION BY transaction_id ORDER BY s DESC, o DESC) AS n FROM x) WHERE n = 1""")
def alert_dedupe(spark, d):
    # many rows per id: each customer's orders stand for copies of one alert
    rows = views.txn_orders(spark, d).select(
        F.col("customer_id").alias("transaction_id"), (F.col("amount") / 10000).alias("overall_risk_score"),
        F.lit(1.0).alias("confidence_score"), F.col("transaction_id").alias("customer_id"), F.lit("LOW").alias("risk_level"),
    )
    best = alerts.one_per_transaction(rows)
    return rounded(best.select("transaction_id", "overall_risk_score", F.col("customer_id").alias("source_order")), 6, "overall_risk_score")


@register("level_priority", """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'P1_CRITICAL' WHEN 'HOUSEHOLD' THEN 'P2_HIGH'
  WHEN 'BUILDING' THEN 'P3_MEDIUM' ELSE 'P4_LOW' END AS priority FROM customer""")
def level_priority(spark, d):
    level = F.create_map(*[F.lit(x) for x in ("MACHINERY", "CRITICAL", "HOUSEHOLD", "HIGH", "BUILDING", "MEDIUM")])
    rows = views.table(spark, d, "customer").withColumn("level", F.coalesce(level[F.col("c_mktsegment")], F.lit("LOW")))
    return rows.select("c_custkey", alerts.priority_from_level(F.col("level")).alias("priority"))


@register("fixed_weight_fusion", f"""WITH x AS (SELECT p_partkey, p_size * 2.0 AS a, CASE WHEN p_size > 10 THEN p_retailprice / 25 END AS b FROM part),
y AS (SELECT *, least(100.0, a * 0.6 + coalesce(b, 0) * 0.5) AS s FROM x)
SELECT p_partkey, {rd('s', 4, 'fused_risk_score')}, CASE WHEN s >= 90 THEN 'CRITICAL' WHEN s >= 75 THEN 'HIGH' WHEN s >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS fused_risk_level FROM y""")
def fixed_weight_fusion(spark, d):
    rows = views.table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 2.0).alias("a"), F.when(F.col("p_size") > 10, F.col("p_retailprice") / 25).alias("b")
    )
    fused = fusion.fixed_weight_fusion(rows, {"a": 0.6, "b": 0.5})
    return rounded(fused.select("p_partkey", "fused_risk_score", "fused_risk_level"), 4, "fused_risk_score")


@register("findings_regrouped", f"""WITH {O.events_fused()}
SELECT transaction_id, rn AS rules, sn AS statistics FROM fused WHERE rn + sn > 0""")
def findings_regrouped(spark, d):
    found = detectors.statistical_findings(detectors.rule_hits(events_with_profiles(spark, d)))
    long = {"rule": detectors.findings_long(found, "rule_hits"), "statistical": detectors.findings_long(found, "statistical_findings")}
    back = fusion.gather_findings(long)
    return back.select("transaction_id", F.size("rule_hits").cast("long").alias("rules"),
                       F.size("statistical_findings").cast("long").alias("statistics"))


@register("investigate_customers", f"""WITH v0 AS (SELECT * FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING sum(value) > 3000)),
{O.events_fused().replace('FROM events)', 'FROM v0)')}
SELECT transaction_id, overall_risk_score AS fused_risk_score, risk_level FROM fused""")
def investigate_customers(spark, d):
    rows = views.txn_events(spark, d)
    chosen = rows.groupBy("customer_id").agg(F.sum("amount").alias("s")).where("s > 3000").select("customer_id")
    return detection.investigate(rows, customers=chosen).select("transaction_id", "fused_risk_score", "risk_level")


@register("customer_risk", f"""WITH {O.events_fused()}
SELECT customer_id, count(*) AS alerts, max(overall_risk_score) AS top_score,
  arg_max(risk_level, CASE risk_level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'VERY HIGH' THEN 3 ELSE 4 END) AS worst_level
FROM fused GROUP BY customer_id""")
def customer_risk(spark, d):
    return reports.customer_risk(all_alerts(spark, d))


@register("customer_risk_profile", f"""WITH {O.events_fused()}, g AS (SELECT customer_id, count(*) AS alerts, max(overall_risk_score) AS top_score FROM fused GROUP BY customer_id),
l AS (SELECT customer_id, {rd('z', 4, 'amount_z_score')}, transactions_last_hour, transactions_last_day, {rd('deviation', 4, 'behaviour_deviation_score')} FROM f
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, transaction_id DESC) = 1)
SELECT p.customer_id, {CONFIDENCE} AS confidence_score, coalesce(alerts, 0) AS alerts, top_score, l.* EXCLUDE (customer_id) FROM p LEFT JOIN g USING (customer_id) LEFT JOIN l USING (customer_id)""")
def customer_risk_profile(spark, d):
    rows = views.txn_events(spark, d)
    heat = find_heat(rows, "customer_id", EngineConfig())
    history = profiles.build_profiles(rows, heat=heat)
    featured = features.build_features(rows, history, heat=heat)
    found = reports.customer_risk(all_alerts(spark, d), history, featured)
    flat = found.select("customer_id", "confidence_score", "alerts", "top_score", "features.*")
    return rounded(flat, 4, "amount_z_score", "behaviour_deviation_score")


@register("kpi_summary", f"""WITH {O.events_fused()}, states AS (SELECT *, CASE WHEN transaction_id IN (SELECT transaction_id FROM v WHERE channel = 'signup') THEN 'CLOSED' ELSE 'OPEN' END AS status FROM fused)
SELECT count(*) AS total_alerts, count(*) FILTER ({PRIORITY} = 'P1_CRITICAL') AS critical_alerts, count(*) FILTER (status = 'OPEN') AS open_alerts,
  count(*) FILTER (status = 'CLOSED') AS closed_alerts, round(count(*) FILTER (status = 'CLOSED') * 100.0 / count(*), 1) AS resolution_rate FROM states""")
def kpi_summary(spark, d):
    rows = views.txn_events(spark, d)
    closed = rows.where(F.col("channel") == "signup").select(
        F.concat(F.lit("ALT-"), F.hex(F.xxhash64(F.col("transaction_id").cast("string")))).alias("alert_id"),
        F.lit("CLOSED").alias("status"), F.col("timestamp").alias("at"),
    )
    return reports.kpi_summary(reports.latest_status(all_alerts(spark, d), closed))


@register("risk_distribution", f"""WITH {O.events_fused()}
SELECT CASE WHEN risk_level IN ('CRITICAL', 'VERY HIGH', 'HIGH') THEN 'High' WHEN risk_level = 'MEDIUM' THEN 'Medium' ELSE 'Low' END AS band,
  count(*) AS alerts FROM fused GROUP BY 1""")
def risk_distribution(spark, d):
    return reports.risk_distribution(all_alerts(spark, d))


@register("alert_page", f"""WITH {O.events_fused()}
SELECT transaction_id, overall_risk_score AS fused_risk_score FROM fused WHERE {PRIORITY} <= 'P2_HIGH'
ORDER BY {PRIORITY}, overall_risk_score DESC, confidence_score DESC, transaction_id LIMIT 50 OFFSET 100""")
def alert_page(spark, d):
    page = reports.alert_query(all_alerts(spark, d), "P2_HIGH", limit=50, offset=100)
    return page.select("transaction_id", "fused_risk_score")


@register("run_report", f"""WITH {O.events_fused()}
SELECT 'transactions_processed' AS metric, count(*) AS value FROM v UNION ALL SELECT 'alerts', count(*) FROM fused
UNION ALL SELECT concat('alerts_', {PRIORITY}), count(*) FROM fused GROUP BY 1""")
def run_report(spark, d):
    return reports.run_report(views.txn_events(spark, d), all_alerts(spark, d))


@register("anomaly_findings", f"""WITH RECURSIVE {O.events_features()}, {O.forest()}
SELECT transaction_id, id, name, {rd('score', 6)}, confidence FROM m""")
def anomaly_findings(spark, d):
    # fitted and scored from features worked out once
    rows = materialise(events_with_profiles(spark, d).select("transaction_id", "customer_id", *anomaly.FEATURES))
    scored = anomaly.fit(rows).transform(rows)
    found = detectors.findings_long(scored, "ml_findings").select("transaction_id", "id", "name", "score", "confidence")
    return rounded(found, 6, "score")


@register("anomaly_scaling", f"""WITH {O.events_features()}
SELECT 'amount_z_score' AS feature, {rd('avg(z)', 4, 'mean')}, {rd('stddev_pop(z)', 4, 'std')} FROM f
UNION ALL SELECT 'transactions_last_day', {rd('avg(transactions_last_day)', 4, 'mean')}, {rd('stddev_pop(transactions_last_day)', 4, 'std')} FROM f""")
def anomaly_scaling(spark, d):
    table = anomaly.scaling(events_with_profiles(spark, d), ("amount_z_score", "transactions_last_day"))
    return rounded(table, 4, "mean", "std")


@register("full_assessment_with_model", f"""WITH RECURSIVE {O.events_features()}, {O.rules()}, {O.statistics()}, {O.behaviour()}, {O.patterns()},
{O.forest()}, {O.fused(model=True)}
SELECT transaction_id, overall_risk_score, risk_level, confidence_score, active_engines, CAST(mn AS INT) AS model_findings,
  CASE WHEN mn > 0 THEN ms ELSE 0 END AS model_score FROM fused""")
def full_assessment_with_model(spark, d):
    rows = views.txn_events(spark, d)
    featured = materialise(with_history(rows))
    assessed = detection.assess(rows, model=anomaly.fit(featured), featured=featured)
    return assessed.select(
        "transaction_id", "overall_risk_score", "risk_level", "confidence_score", "active_engines", F.size("ml_findings").alias("model_findings"),
        F.round(F.col("engine_scores")["ML"], 2).alias("model_score"),
    )


# --- quality, cleaning, enrichment ----------------------------------------------------------------------------


@register("fk_orphans", """SELECT l_partkey, count(*) AS rows FROM lineitem WHERE l_partkey NOT IN (SELECT CASE WHEN p_size > 25 THEN p_partkey ELSE -p_partkey END FROM part)
GROUP BY l_partkey""")
def fk_orphans(spark, d):
    # half of the parents get another key, so that orphans exist
    parents = views.table(spark, d, "part").select(F.expr("IF(p_size > 25, p_partkey, -p_partkey)").alias("p_partkey"))
    lost = quality.orphans(views.table(spark, d, "lineitem"), "l_partkey", parents, "p_partkey")
    return lost.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("rows"))


def fk_sql(child: str, key: str, parent: str, parent_key: str) -> str:
    lost = f"SELECT {key} FROM {child} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM {parent})"
    return f"""SELECT '{child}' AS "table", '{key}' AS "column", (SELECT count(*) FROM ({lost})) AS violations,
  (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST({key} AS VARCHAR) AS k FROM (SELECT DISTINCT {key} FROM ({lost}) ORDER BY 1 LIMIT 5))) AS sample"""


FKS = (
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "supplier", "s_suppkey"),
)


@register("fk_report", " UNION ALL ".join(fk_sql(*fk) for fk in FKS))
def fk_report(spark, d):
    names = {t for c, _, p, _ in FKS for t in (c, p)}
    report = quality.key_report({t: views.table(spark, d, t) for t in names}, {}, [(*fk, True) for fk in FKS])
    return report.select("table", "column", "violations", "sample")


KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "events": "event_id", "nation": "n_nationkey"}


def unique_sql(table: str, key: str) -> str:
    return f"""SELECT '{table}' AS "table", 'unique' AS "check", '{key}' AS "column", count(*) - count(DISTINCT {key}) AS violations,
  (SELECT CAST(min({key}) AS VARCHAR) FROM (SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1)) AS sample FROM {table}"""


@register("reference_report", " UNION ALL ".join([
    *(unique_sql(t, k) for t, k in KEYS.items()),
    *(f"""SELECT "table", 'foreign_key->{fk[2]}.{fk[3]}' AS "check", "column", violations, sample FROM ({fk_sql(*fk)})""" for fk in FKS)]))
def reference_report(spark, d):
    """Six primary and six foreign keys of nine tables from one scan of each."""
    names = {*KEYS, *(t for c, _, p, _ in FKS for t in (c, p))}
    return quality.key_report({t: views.table(spark, d, t) for t in names}, KEYS, [(*fk, True) for fk in FKS])


@register("duplicate_keys", "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return quality.duplicate_keys(views.table(spark, d, "lineitem"), "l_orderkey")


@register("unique_checks", """SELECT 'orders' AS "table", count(*) - count(DISTINCT o_orderkey) AS violations FROM orders
UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'lineitem', count(*) - count(DISTINCT l_orderkey) FROM lineitem""")
def unique_checks(spark, d):
    keys = {"orders": "o_orderkey", "documents": "doc_id", "lineitem": "l_orderkey"}
    return quality.together(quality.unique_check(views.table(spark, d, t), k, t) for t, k in keys.items()).select("table", "violations")


@register("null_profile", """SELECT "column", nulls, rows FROM (
  SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS nulls, count(*) AS rows FROM j UNION ALL
  SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL), count(*) FROM j UNION ALL
  SELECT 'c_name', count(*) FILTER (c_name IS NULL), count(*) FROM j)""".replace(
    " FROM j", " FROM (SELECT o_orderkey, o_totalprice, c_name FROM customer FULL JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS o_totalprice, CASE WHEN o_totalprice > 250000 THEN o_custkey END AS o_custkey FROM orders) ON c_custkey = o_custkey)"))
def null_profile(spark, d):
    large = F.col("o_totalprice") > 250000
    orders = views.table(spark, d, "orders").withColumns({c: F.when(large, F.col(c)) for c in ("o_custkey", "o_totalprice")})
    joined = views.table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "full")
    return quality.null_profile(joined.select("o_orderkey", "o_totalprice", "c_name")).drop("ratio")


@register("range_violations", """SELECT 'l_extendedprice' AS "column", count(*) FILTER (l_extendedprice < 2000) AS violations,
  CAST(min(CASE WHEN l_extendedprice < 2000 THEN l_extendedprice END) AS VARCHAR) AS sample FROM lineitem
UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal < 0), CAST(min(CASE WHEN c_acctbal < 0 THEN c_acctbal END) AS VARCHAR) FROM customer""")
def range_violations(spark, d):
    parts = [
        quality.range_check(views.table(spark, d, "lineitem"), "l_extendedprice", low=2000, table="lineitem"),
        quality.range_check(views.table(spark, d, "customer"), "c_acctbal", low=0, table="customer"),
    ]
    return quality.together(parts).select("column", "violations", "sample")


@register("timestamp_violations", """SELECT 'ts' AS "column", CAST(0 AS BIGINT) AS violations UNION ALL
SELECT 'event_type', count(*) FROM events WHERE event_type IS NOT NULL""")
def timestamp_violations(spark, d):
    events = views.table(spark, d, "events")
    parts = [quality.timestamp_check(events, c, "events") for c in ("ts", "event_type")]
    return quality.together(parts).select("column", "violations")


@register("clean_strings", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\x00-\x1F\x{7F}-\x{9F}]', '', 'g'), '\s+', ' ', 'g')) AS clean_md5
FROM documents""")
def clean_strings(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    return cleaning.clean_strings(docs).select("doc_id", F.md5("text").alias("clean_md5"))


@register("dedupe_rows", "SELECT DISTINCT text, lang FROM documents".replace("text", "md5(text) AS text_md5"))
def dedupe_rows(spark, d):
    docs = views.table(spark, d, "documents").select("text", "lang")
    return cleaning.drop_duplicate_rows(docs).select(F.md5("text").alias("text_md5"), "lang")


SPARSE = """FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_totalprice > 300000 THEN o_orderpriority END AS o_orderpriority FROM orders) ON c_custkey = o_custkey"""


@register("impute_median_mode", f"""WITH j AS (SELECT c_custkey, o_orderkey, o_totalprice, o_orderpriority {SPARSE}),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM j),
t AS (SELECT o_orderpriority AS top FROM j WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, {rd('coalesce(o_totalprice, med)', 4, 'o_totalprice')}, coalesce(o_orderpriority, top) AS o_orderpriority FROM j, m, t""")
def impute_median_mode(spark, d):
    large = F.col("o_totalprice") > 300000
    orders = views.table(spark, d, "orders").withColumns({c: F.when(large, F.col(c)) for c in ("o_totalprice", "o_orderpriority")})
    joined = views.table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = joined.select("c_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    filled = cleaning.impute(rows, ["o_totalprice", "o_orderpriority"])
    return rounded(filled.withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1))), 4, "o_totalprice")


@register("coerced_types", """SELECT doc_id, TRY_CAST(split_part(text, ' ', 1) AS DOUBLE) IS NULL AS not_a_number,
  lower(lang) IN ('true', '1') AS flag, TRY_CAST(source AS TIMESTAMP) IS NULL AS not_a_time FROM documents""")
def coerced_types(spark, d):
    docs = views.table(spark, d, "documents").select(
        "doc_id", F.get(F.split("text", " "), F.lit(0)).alias("amount"), F.col("lang").alias("is_pep"), F.col("source").alias("timestamp")
    )
    typed = cleaning.normalise_types(docs, "transaction")
    return typed.select("doc_id", F.col("amount").isNull().alias("not_a_number"),
                        cleaning.to_boolean(F.col("is_pep")).alias("flag"), F.col("timestamp").isNull().alias("not_a_time"))


@register("time_parts", f"""WITH {O.EV} SELECT transaction_id, hour_of_day, day_of_week, transaction_month, is_weekend, is_business_hours,
  CAST(day(ts) AS INT) AS day_of_month, CAST(year(ts) AS INT) AS transaction_year FROM v JOIN (SELECT event_id AS transaction_id, ts AS ts2 FROM events) USING (transaction_id)""")
def time_parts(spark, d):
    return with_time_parts(views.txn_events(spark, d)).select(
        "transaction_id", "hour_of_day", "day_of_week", "transaction_month", "is_weekend", "is_business_hours",
        "day_of_month", "transaction_year",
    )


@register("quality_report", """SELECT count(*) AS rows_in, count(DISTINCT (lang, source)) AS rows_out, count(*) - count(DISTINCT (lang, source)) AS duplicates_removed FROM documents""")
def quality_report(spark, d):
    before = views.table(spark, d, "documents").select("lang", "source")
    report = cleaning.quality_report(before, cleaning.drop_duplicate_rows(before), "documents")
    return report.select("rows_in", "rows_out", "duplicates_removed")


PAIRS_SQL = "(SELECT c_custkey AS a, c_custkey % 40 + 1 AS b FROM customer)"


@register("network_columns", f"""WITH t AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderkey % 400 AS partner, o_orderdate AS ts, o_totalprice AS amount FROM orders),
r AS (SELECT a, b FROM {PAIRS_SQL} UNION SELECT b, a FROM {PAIRS_SQL}), n AS (SELECT a, sum(CASE WHEN a = b THEN 2 ELSE 1 END) AS n FROM r GROUP BY a)
SELECT transaction_id, count(*) OVER h AS txn_count_1h, count(*) OVER d AS txn_count_24h, {rd('sum(amount) OVER d', 2, 'txn_amount_24h')},
  CAST(coalesce(n.n, 0) AS BIGINT) AS relationship_count, (customer_id, partner) IN (SELECT (a, b) FROM r) AS counterparty_relationship_exists
FROM t LEFT JOIN n ON n.a = customer_id
WINDOW h AS (PARTITION BY customer_id ORDER BY ts {O.back(O.HOUR)}), d AS (PARTITION BY customer_id ORDER BY ts {O.back(O.DAY)})""")
def network_columns(spark, d):
    rows = views.txn_orders(spark, d).withColumn("counterparty_account_id", F.concat(F.lit("A"), F.col("transaction_id") % 400))
    customers = views.table(spark, d, "customer").select("c_custkey")
    accounts = customers.select(F.concat(F.lit("A"), "c_custkey").alias("account_id"), F.col("c_custkey").alias("customer_id"))
    pairs = customers.select(F.col("c_custkey").alias("customer_id_1"), (F.col("c_custkey") % 40 + 1).alias("customer_id_2"))
    found = enrichment.network_columns(rows, accounts, pairs)
    names = ("txn_count_1h", "txn_count_24h", "txn_amount_24h", "relationship_count", "counterparty_relationship_exists")
    return rounded(found.select("transaction_id", *names), 2, "txn_amount_24h")


def banking_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Transactions, customers, accounts and country risk shaped from the driver tables."""
    orders, customer = views.table(spark, d, "orders"), views.table(spark, d, "customer")
    nation = views.table(spark, d, "nation")
    txns = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == nation.n_nationkey).select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("amount"), F.col("n_name").alias("counterparty_country"),
    )
    customers = customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("profile_segment"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("age"), F.col("c_acctbal").alias("annual_income"),
        F.when(F.col("c_nationkey") < 10, "High").otherwise("Low").alias("kyc_level"),
        F.when(F.col("c_nationkey") < 3, True).alias("is_pep"), F.lit(None).cast("boolean").alias("sanctions_hit"),
        F.col("c_acctbal").alias("risk_score"),
    )
    accounts = customer.select(
        F.col("c_custkey").alias("account_id"), F.when(F.col("c_acctbal") < 0, "Dormant").otherwise("Active").alias("status"),
        F.date_add(F.lit("2023-06-01").cast("date"), (F.col("c_nationkey") * 20).cast("int")).alias("open_date"),
        F.col("c_acctbal").alias("avg_monthly_balance"),
    )
    country = nation.select(
        F.col("n_name").alias("country_code"), F.when(F.col("n_regionkey") == 0, "Grey").otherwise("Normal").alias("fatf_status"),
        F.col("n_regionkey").cast("double").alias("risk_score"),
    )
    return txns, customers, accounts, country


BAND = """CASE WHEN a > 0 AND a <= 18 THEN 'Under 18' WHEN a > 18 AND a <= 30 THEN '18-30' WHEN a > 30 AND a <= 50 THEN '31-50'
  WHEN a > 50 AND a <= 70 THEN '51-70' WHEN a > 70 AND a <= 120 THEN 'Over 70' ELSE 'Unknown' END"""
ENRICHED = f"""e AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount, {BAND} AS customer_age_group,
  greatest(0, date_diff('day', DATE '2023-06-01' + CAST(c_nationkey * 20 AS INT), DATE '2024-01-01')) AS account_age_days,
  c_mktsegment AS profile_segment, CASE WHEN c_nationkey < 10 THEN 'High' ELSE 'Low' END AS kyc_level, c_nationkey < 3 AS is_pep,
  false AS sanctions_hit, CASE WHEN n_regionkey = 0 THEN 'Grey' ELSE 'Normal' END AS fatf_status, c_acctbal,
  CASE WHEN c_acctbal < 0 THEN 'Dormant' ELSE 'Active' END AS account_status
  FROM orders JOIN (SELECT *, CAST(floor(c_acctbal / 100) AS INT) AS a FROM customer) ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@register("enriched_join", f"""WITH {ENRICHED} SELECT transaction_id, customer_age_group, CAST(account_age_days AS INT) AS account_age_days, profile_segment,
  kyc_level, is_pep, sanctions_hit, fatf_status, account_status FROM e""")
def enriched_join(spark, d):
    return enrichment.enrich(*banking_tables(spark, d)).select(
        "transaction_id", "customer_age_group", "account_age_days", "profile_segment", "kyc_level", "is_pep", "sanctions_hit",
        "fatf_status", "account_status",
    )


@register("optional_enrichment", f"""WITH {ENRICHED} SELECT transaction_id, {rd('amount / nullif(c_acctbal, 0)', 4, 'amount_to_income_ratio')},
  account_status = 'Dormant' AS is_dormant_account, fatf_status IN ('Grey', 'Black') AS is_high_risk_counterparty,
  CASE WHEN kyc_level = 'High' THEN 1.0 ELSE 0.3 END AS kyc_risk_weight, CASE WHEN fatf_status = 'Grey' THEN 0.6 ELSE 0.1 END AS fatf_risk_weight FROM e""")
def optional_enrichment(spark, d):
    rows = enrichment.optional_enrichment(enrichment.enrich(*banking_tables(spark, d)))
    return rounded(rows.select("transaction_id", "amount_to_income_ratio", "is_dormant_account", "is_high_risk_counterparty",
                               "kyc_risk_weight", "fatf_risk_weight"), 4, "amount_to_income_ratio")


@register("basic_features", f"""WITH {ENRICHED} SELECT transaction_id, CAST(amount % 1000 = 0 AS INT) AS is_round_amount, CAST(is_pep AS INT) AS is_pep_int,
  0 AS sanctions_int, CASE WHEN kyc_level = 'High' THEN 3 ELSE 1 END AS kyc_ordinal FROM e""")
def basic_features(spark, d):
    return enrichment.basic_features(enrichment.enrich(*banking_tables(spark, d))).select(
        "transaction_id", "is_round_amount", "is_pep_int", "sanctions_int", "kyc_ordinal"
    )


@register("relationship_degree", """SELECT node AS customer_id, CAST(sum(CASE WHEN node = other THEN 2 ELSE 1 END) AS BIGINT) AS relationship_degree FROM (
  SELECT o_custkey AS node, l_suppkey AS other FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY node""")
def relationship_degree(spark, d):
    lines, orders = views.table(spark, d, "lineitem"), views.table(spark, d, "orders")
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("customer_id_1"), F.col("l_suppkey").alias("customer_id_2")
    )
    return enrichment.relationship_degree(pairs)


# --- typologies ---------------------------------------------------------------------------------------------------


@register("structuring_5d", f"""WITH {O.LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY counterparty_account_id ORDER BY ts {O.back(5 * O.DAY)}) AS near_threshold_count
  FROM v WHERE amount BETWEEN 0.85 * 50000 AND 0.98 * 50000)
SELECT transaction_id, near_threshold_count FROM n WHERE near_threshold_count >= 3""")
def structuring_5d(spark, d):
    found = typologies.structuring(views.txn_lines(spark, d), "counterparty_account_id", 50_000.0, credit_types=None)
    return found.select("transaction_id", "near_threshold_count")


@register("smurfing_48h", f"""WITH {O.EDGES}, n AS (SELECT transaction_id, CAST(list_unique(list(src) OVER (PARTITION BY dst ORDER BY ts {O.back(2 * O.DAY)})) AS BIGINT) AS senders FROM ed)
SELECT * FROM n WHERE senders >= 4""")
def smurfing_48h(spark, d):
    return typologies.smurfing(views.flow_edges(spark, d)).select("transaction_id", "senders")


@register("velocity_and_bursts", f"""WITH {O.EV}, n AS (SELECT transaction_id, count(*) OVER (PARTITION BY customer_id ORDER BY ts {O.back(O.DAY)}) AS count_24h,
  count(*) OVER (PARTITION BY customer_id ORDER BY ts {O.back(O.HOUR)}) AS count_1h FROM v)
SELECT *, count_24h > 8 AS is_velocity, count_1h > 5 AS is_burst FROM n""")
def velocity_and_bursts(spark, d):
    rows = typologies.velocity_anomalies(views.txn_events(spark, d), "customer_id")
    return rows.select("transaction_id", "count_24h", "count_1h", "is_velocity", "is_burst")


@register("bursts", f"""WITH {O.EV}, n AS (SELECT transaction_id, count(*) OVER (PARTITION BY customer_id ORDER BY ts {O.back(O.DAY)}) AS count_24h,
  count(*) OVER (PARTITION BY customer_id ORDER BY ts {O.back(O.HOUR)}) AS count_1h FROM v)
SELECT *, count_24h > 4 AS is_velocity, count_1h > 1 AS is_burst FROM n""")
def bursts(spark, d):
    """At limits that these sparse events reach."""
    rows = typologies.velocity_anomalies(views.txn_events(spark, d), "customer_id", EngineConfig(velocity_max_per_day=4, burst_max_per_hour=1))
    return rows.select("transaction_id", "count_24h", "count_1h", "is_velocity", "is_burst")


FOLLOWS = "b.src = a.dst AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {hours} HOUR AND b.amount / a.amount >= {low} AND b.amount / a.amount <= {high}"


@register("chain_3hop", f"""WITH {O.EDGES},
l2 AS (SELECT DISTINCT b.* FROM ed a JOIN ed b ON {FOLLOWS.format(hours=720, low=0.92, high=0.99)}),
l3 AS (SELECT DISTINCT b.* FROM l2 a JOIN ed b ON {FOLLOWS.format(hours=720, low=0.92, high=0.99)})
SELECT transaction_id, src, dst, {rd('amount', 2, 'amount')} FROM l3""")
def chain_3hop(spark, d):
    cfg = EngineConfig(hop_hours=720)
    return rounded(typologies.layering_chains(views.flow_edges(spark, d), cfg).select("transaction_id", "src", "dst", "amount"), 2, "amount")


@register("chain_members_3hop", f"""WITH {O.EDGES},
p2 AS (SELECT a.transaction_id AS i1, b.* FROM ed a JOIN ed b ON {FOLLOWS.format(hours=720, low=0.92, high=0.99)}),
p3 AS (SELECT a.i1, a.transaction_id AS i2, b.transaction_id AS i3 FROM p2 a JOIN ed b ON {FOLLOWS.format(hours=720, low=0.92, high=0.99)}),
m AS (SELECT i1 AS transaction_id, 0 AS place FROM p3 UNION ALL SELECT i2, 1 FROM p3 UNION ALL SELECT i3, 2 FROM p3)
SELECT transaction_id, min(place) = 0 AS is_first, max(place) = 2 AS is_last FROM m GROUP BY transaction_id""")
def chain_members_3hop(spark, d):
    found = typologies.layering_members(views.flow_edges(spark, d), EngineConfig(hop_hours=720))
    return found.select("transaction_id", "is_first", "is_last")


@register("cycle_4", f"""WITH {O.EDGES}, e AS (SELECT * FROM ed WHERE src <> dst),
p2 AS (SELECT a.transaction_id AS i1, b.transaction_id AS i2, a.src AS origin, a.dst AS n2, b.* FROM e a JOIN e b ON {FOLLOWS.format(hours=1440, low=0.5, high=1.0)} AND b.dst <> a.src),
p3 AS (SELECT a.i1, a.i2, b.transaction_id AS i3, a.origin, a.n2, a.src AS n3, b.* FROM p2 a JOIN e b ON {FOLLOWS.format(hours=1440, low=0.5, high=1.0)} AND b.dst <> a.origin AND b.dst <> a.n2)
SELECT a.i1 AS t1, a.i2 AS t2, a.i3 AS t3, b.transaction_id AS t4 FROM p3 a JOIN e b ON {FOLLOWS.format(hours=1440, low=0.5, high=1.0)} AND b.dst = a.origin""")
def cycle_4(spark, d):
    # payers and sellers alternate, so the shortest cycle in these tables has four accounts
    found = typologies.circular_flows(views.flow_edges(spark, d), nodes=4, ratio=(0.5, 1.0), hours=1440)
    return found.select(*[F.get("transactions", F.lit(i)).alias(f"t{i + 1}") for i in range(4)])


NATIONS = f"""ne AS (
  SELECT {O.LINE_ID} AS transaction_id, CASE WHEN l_returnflag = 'R' THEN ns.n_name ELSE nc.n_name END AS src,
    CASE WHEN l_returnflag = 'R' THEN nc.n_name ELSE ns.n_name END AS dst, l_shipdate AS ts, l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey)"""
NEXT = FOLLOWS.format(hours=240, low=0.95, high=1.0).replace("a.dst", "a.nodes[-1]").replace("a.ts", "a.last_ts").replace("a.amount", "a.last_amount")


@register("cycles_3_to_6", f"""WITH RECURSIVE {NATIONS}, e AS (SELECT * FROM ne WHERE src <> dst),
p AS (SELECT [transaction_id] AS ids, [src, dst] AS nodes, ts AS last_ts, amount AS last_amount, false AS closed FROM e UNION ALL
  SELECT list_append(a.ids, b.transaction_id), list_append(a.nodes, b.dst), b.ts, b.amount, b.dst = a.nodes[1]
  FROM p a JOIN e b ON {NEXT} WHERE NOT a.closed AND len(a.ids) < 6 AND (NOT list_contains(a.nodes, b.dst) OR b.dst = a.nodes[1] AND len(a.ids) >= 2))
SELECT len(ids) AS accounts, array_to_string(ids, ' ') AS transactions, array_to_string(nodes[:-2], ' > ') AS route FROM p WHERE closed""")
def cycles_3_to_6(spark, d):
    found = typologies.circular_flows(views.nation_flows(spark, d), nodes=3, ratio=(0.95, 1.0), hours=240, up_to=6)
    return found.select(
        F.size("transactions").cast("long").alias("accounts"), F.array_join("transactions", " ").alias("transactions"), F.array_join("accounts", " > ").alias("route"),
    )


@register("hub_chain_members", f"""WITH {NATIONS},
p2 AS (SELECT a.transaction_id AS i1, b.* FROM ne a JOIN ne b ON {FOLLOWS.format(hours=240, low=0.92, high=0.99)}),
p3 AS (SELECT a.i1, a.transaction_id AS i2, b.transaction_id AS i3 FROM p2 a JOIN ne b ON {FOLLOWS.format(hours=240, low=0.92, high=0.99)}),
m AS (SELECT i1 AS transaction_id, 0 AS place FROM p3 UNION ALL SELECT i2, 1 FROM p3 UNION ALL SELECT i3, 2 FROM p3)
SELECT transaction_id, min(place) = 0 AS is_first, max(place) = 2 AS is_last FROM m GROUP BY transaction_id""")
def hub_chain_members(spark, d):
    """Chains among few accounts, the hot ones by slices (every account is hot at this limit)."""
    cfg = EngineConfig(hop_hours=240, hot_key_rows=1000, slice_rows=5000)
    return typologies.layering_members(views.nation_flows(spark, d), cfg).select("transaction_id", "is_first", "is_last")


@register("mule_pass_through", f"""WITH {O.EDGES}, n AS (SELECT i.transaction_id, i.dst AS account, i.amount AS amount_in,
  (SELECT coalesce(sum(o.amount), 0) FROM ed o WHERE o.src = i.dst AND o.ts > i.ts AND o.ts <= i.ts + INTERVAL 24 HOUR) AS amount_out FROM ed i)
SELECT transaction_id, account, {rd('amount_in', 2, 'amount_in')}, {rd('amount_out', 2, 'amount_out')} FROM n WHERE amount_out >= 0.85 * amount_in""")
def mule_pass_through(spark, d):
    found = typologies.mule_pass_through(views.flow_edges(spark, d))
    return rounded(found.select("transaction_id", "account", "amount_in", "amount_out"), 2, "amount_in", "amount_out")


@register("dormant_gap_90d", f"""WITH {O.ORDERS}, n AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, transaction_id), ts) / 86400000000.0 AS idle_days FROM v)
SELECT transaction_id, idle_days FROM n WHERE idle_days > 90 AND amount >= 100000""")
def dormant_gap_90d(spark, d):
    found = typologies.dormant_activation(views.txn_orders(spark, d), "customer_id", 100_000.0)
    return found.select("transaction_id", "idle_days")


@register("balance_reconciliation", f"""WITH {O.ORDERS}, b AS (SELECT transaction_id, customer_id, ts, amount, transaction_type = 'P' AS credit,
  CASE WHEN amount > 400000 THEN -1.0 ELSE amount END AS bal FROM v),
n AS (SELECT *, bal - lag(bal) OVER (PARTITION BY customer_id ORDER BY ts, transaction_id) - CASE WHEN credit THEN amount ELSE -amount END AS gap FROM b)
SELECT transaction_id, {rd('gap', 2, 'balance_gap')} FROM n WHERE round(abs(gap), 6) > 0.01 OR bal < 0""")
def balance_reconciliation(spark, d):
    rows = views.txn_orders(spark, d).withColumns(
        {
            "account_id": F.col("customer_id"),
            "transaction_type": F.when(F.col("transaction_type") == "P", "Credit").otherwise("Debit"),
            "balance_after": F.when(F.col("amount") > 400_000, -1.0).otherwise(F.col("amount")),
        }
    )
    return rounded(typologies.balance_reconciliation(rows).select("transaction_id", "balance_gap"), 2, "balance_gap")


@register("round_amounts", "SELECT p_partkey AS transaction_id, p_retailprice AS amount FROM part WHERE p_retailprice IN (900, 950, 1000, 1050, 1100)")
def round_amounts(spark, d):
    cfg = EngineConfig(round_amounts=(900.0, 950.0, 1000.0, 1050.0, 1100.0))
    prices = views.table(spark, d, "part").select(F.col("p_partkey").alias("transaction_id"), F.col("p_retailprice").alias("amount"))
    return typologies.round_amounts(prices, cfg)


@register("high_risk_geography", f"""WITH {O.LINES} SELECT transaction_id, counterparty_country, CASE n_regionkey WHEN 0 THEN 'Grey' ELSE 'Black' END AS listed_as
FROM v JOIN nation ON counterparty_country = n_name WHERE n_regionkey IN (0, 1)""")
def high_risk_geography(spark, d):
    status = F.when(F.col("n_regionkey") == 0, "Grey").when(F.col("n_regionkey") == 1, "Black").otherwise("Normal")
    country = views.table(spark, d, "nation").select(F.col("n_name").alias("country_code"), status.alias("fatf_status"))
    return typologies.high_risk_geography(views.txn_lines(spark, d), country).select("transaction_id", "counterparty_country", "listed_as")


@register("cross_border_unusual", f"""WITH {O.LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY customer_id, counterparty_country ORDER BY ts, transaction_id) AS k FROM v)
SELECT transaction_id, customer_id, counterparty_country FROM n WHERE k = 1 AND counterparty_country <> location_country""")
def cross_border_unusual(spark, d):
    return typologies.cross_border_unusual(views.txn_lines(spark, d)).select("transaction_id", "customer_id", "counterparty_country")


@register("trade_based", f"""WITH {O.LINES} SELECT transaction_id FROM (SELECT transaction_id, merchant_id, floor(amount / 10000) * 10000 AS amount FROM v)
JOIN part ON merchant_id = p_partkey WHERE amount > 0 AND p_type = 'ECONOMY'""")
def trade_based(spark, d):
    lines = views.txn_lines(spark, d).withColumn("amount", F.floor(F.col("amount") / 10_000) * 10_000.0)
    kind = F.when(F.col("p_type") == "ECONOMY", "Building Materials").otherwise("Other")
    merchants = views.table(spark, d, "part").select(F.col("p_partkey").alias("merchant_id"), kind.alias("category"))
    return typologies.trade_based(lines, merchants).select("transaction_id")


@register("shell_pass_through", f"""WITH {O.ORDERS} SELECT customer_id AS account_id, count(*) AS txns, {rd('sum(amount)', 2, 'volume')} FROM v
GROUP BY customer_id HAVING count(*) = count(*) FILTER (amount >= 60000)""")
def shell_pass_through(spark, d):
    rows = views.txn_orders(spark, d).withColumns({"account_id": F.col("customer_id"), "transaction_type": F.lit("Transfer")})
    found = typologies.shell_pass_through(rows, 60_000.0)
    return rounded(found.select("account_id", "txns", "volume"), 2, "volume")


@register("relationship_based", """SELECT o_orderkey AS transaction_id FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey > 5""")
def relationship_based(spark, d):
    orders, customer, nation = (views.table(spark, d, t) for t in ("orders", "customer", "nation"))
    edges = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .select(F.col("o_orderkey").alias("transaction_id"), F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    )
    owners = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("account_id"), F.concat(F.lit("n"), "n_nationkey").alias("customer_id"))
    regions = views.table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("account_id"), F.concat(F.lit("r"), "r_regionkey").alias("customer_id"))
    related = nation.select(
        F.when(F.col("n_nationkey") > 5, F.concat(F.lit("r"), "n_regionkey")).otherwise("nobody").alias("customer_id_1"), F.concat(F.lit("n"), "n_nationkey").alias("customer_id_2")
    )
    return typologies.relationship_based(edges, owners.unionByName(regions), related).select("transaction_id")


@register("integration_after_layering", """WITH x AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate AS ts, o_totalprice AS amount, o_orderpriority = '1-URGENT' AS online FROM orders),
l AS (SELECT customer_id, min(ts) AS since FROM x WHERE NOT online AND amount > 400000 GROUP BY customer_id)
SELECT transaction_id FROM x JOIN l USING (customer_id) WHERE online AND amount >= 300000 AND ts > since""")
def integration_after_layering(spark, d):
    orders = views.txn_orders(spark, d)
    urgent = F.col("channel") == "1-URGENT"
    layered = orders.where(~urgent & (F.col("amount") > 400_000))
    shaped = orders.withColumns(
        {"transaction_type": F.lit("Debit"), "channel": F.when(urgent, "Online").otherwise("Branch"), "merchant_id": F.lit("m")}
    )
    return typologies.integration(shaped, 300_000.0, layered).select("transaction_id")


@register("shared_device", f"""WITH {O.EV}, s AS (SELECT device_id, count(DISTINCT customer_id) AS device_customers FROM v WHERE device_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT customer_id) >= 2)
SELECT transaction_id, device_id, device_customers FROM v JOIN s USING (device_id)""")
def shared_device(spark, d):
    return typologies.shared_devices(views.txn_events(spark, d)).select("transaction_id", "device_id", "device_customers")


@register("ring_members", """SELECT o_orderkey AS transaction_id, n_name AS fraud_ring_id, CASE WHEN c_acctbal > 5000 THEN 'Leader' ELSE 'Member' END AS role
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0""")
def ring_members(spark, d):
    nation = views.table(spark, d, "nation")
    members = views.table(spark, d, "customer").join(nation, F.col("c_nationkey") == nation.n_nationkey).select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("customer_id"), F.col("n_name").alias("fraud_ring_id"),
        F.when(F.col("c_acctbal") > 5000, "Leader").otherwise("Member").alias("role"),
    )
    return typologies.ring_members(views.txn_orders(spark, d), members).select("transaction_id", "fraud_ring_id", "role")


@register("scenario_evaluation", f"""WITH {O.EV}, t AS (SELECT transaction_id, CASE WHEN amount > 200 THEN 'Velocity Anomalies' ELSE 'Transaction Bursts' END AS scenario FROM v WHERE channel = 'error'),
m AS (SELECT transaction_id, 'Velocity Anomalies' AS scenario FROM v WHERE amount > 150 UNION ALL SELECT transaction_id, 'Transaction Bursts' FROM v WHERE amount < 20),
j AS (SELECT coalesce(t.scenario, m.scenario) AS scenario, t.transaction_id AS a, m.transaction_id AS b FROM t FULL JOIN m ON t.transaction_id = m.transaction_id AND t.scenario = m.scenario)
SELECT scenario, count(a) AS labelled, count(b) AS flagged, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS hits,
  round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(b), 4) AS precision, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(a), 4) AS recall
FROM j GROUP BY scenario""")
def scenario_evaluation(spark, d):
    rows = views.txn_events(spark, d)
    tag = F.when(F.col("amount") > 200, "Velocity Anomalies").otherwise("Transaction Bursts")
    labelled = rows.withColumn("aml_scenario_tag", F.when(F.col("channel") == "error", tag))
    flagged = {"Velocity Anomalies": rows.where("amount > 150"), "Transaction Bursts": rows.where("amount < 20")}
    return typologies.scenario_evaluation(labelled, flagged)


# --- reports -------------------------------------------------------------------------------------------------------


@register("row_counts", """SELECT 'orders' AS "table", count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def row_counts(spark, d):
    return reports.row_counts({t: views.table(spark, d, t) for t in ("orders", "customer", "lineitem")})


@register("label_distribution", "SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS rows FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_distribution(spark, d):
    labelled = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id", "left")
    both = reports.distribution(labelled.withColumn("_pair", F.struct("quality", "toxic")), "_pair")
    unknown = F.lit(-1)
    return both.select(
        F.coalesce("_pair.quality", unknown).alias("quality"), F.coalesce("_pair.toxic", unknown).alias("toxic"), "rows"
    )


@register("amount_summary", f"""WITH {O.EV} SELECT count(amount) AS count, {rd('avg(amount)', 4, 'mean')}, {rd('stddev_samp(amount)', 4, 'std')}, min(amount) AS min,
  {rd('quantile_cont(amount, 0.25)', 4, 'q25')}, {rd('quantile_cont(amount, 0.5)', 4, 'q50')}, {rd('quantile_cont(amount, 0.75)', 4, 'q75')}, max(amount) AS max FROM v""")
def amount_summary(spark, d):
    return rounded(reports.amount_summary(views.txn_events(spark, d)), 4, "mean", "std", "q25", "q50", "q75")


@register("weekday_trend", f"""WITH {O.EV} SELECT day_of_week AS day_index, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][day_of_week + 1] AS weekday, count(*) AS rows
FROM v GROUP BY 1, 2""")
def weekday_trend(spark, d):
    return reports.weekday_trend(views.txn_events(spark, d))


@register("recent_five", f"WITH {O.EV} SELECT transaction_id, customer_id, amount FROM v ORDER BY ts DESC, transaction_id LIMIT 5")
def recent_five(spark, d):
    return reports.recent_activity(views.txn_events(spark, d)).select("transaction_id", "customer_id", "amount")


@register("alert_search", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%r#0000001%' AND c_mktsegment = 'BUILDING'")
def alert_search(spark, d):
    return reports.search(views.table(spark, d, "customer"), "R#0000001", ("c_name",), c_mktsegment="BUILDING").select("c_custkey", "c_name")


@register("filtered_alerts", f"""WITH {O.LINES} SELECT transaction_id, {rd('amount', 2, 'amount')} FROM v
WHERE amount >= 20000 AND amount <= 90000 AND ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '2000-01-01' AND counterparty_country IN ('NATION_1', 'NATION_2')""")
def filtered_alerts(spark, d):
    rows = reports.filter_alerts(views.txn_lines(spark, d), 20_000.0, 90_000.0, "1998-01-01", "1999-12-31", ["NATION_1", "NATION_2"])
    return rounded(rows.select("transaction_id", "amount"), 2, "amount")


@register("date_filter", "SELECT event_id AS transaction_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'")
def date_filter(spark, d):
    return detection.filter_by_date(views.txn_events(spark, d), "2024-01-10", "2024-01-20").select("transaction_id")


def execution_log(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as execution records; labelled documents as their feedback."""
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("PARTIAL_SUCCESS")
    log = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("execution_id"), F.col("o_orderpriority").alias("session_id"), status.alias("status"),
        (F.col("o_totalprice") / 1000).alias("duration_seconds"),
    )
    kind = F.when(F.col("quality") == 1, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE")
    feedback = views.table(spark, d, "labels").select(
        F.col("doc_id").alias("execution_id"), kind.alias("feedback_type"),
        F.when(F.col("toxic") == 1, "note").alias("investigator_notes"), F.lit(1).alias("at"),
    )
    return log, feedback


@register("learning_summary", """WITH l AS (SELECT o_orderstatus, o_totalprice / 1000 AS dur, quality, toxic FROM orders LEFT JOIN labels ON o_orderkey = doc_id)
SELECT count(*) AS total_executions, count(*) FILTER (o_orderstatus = 'F') AS completed_executions, count(*) FILTER (o_orderstatus = 'O') AS failed_executions,
  count(*) FILTER (o_orderstatus = 'P') AS partial_success_executions, CAST(0 AS BIGINT) AS cancelled_executions,
  count(*) FILTER (quality = 1) AS feedback_true_positive, count(*) FILTER (quality = 0) AS feedback_false_positive,
  CAST(0 AS BIGINT) AS feedback_true_negative, CAST(0 AS BIGINT) AS feedback_false_negative, CAST(0 AS BIGINT) AS feedback_investigator_note,
  count(*) FILTER (toxic = 1) AS notes, round(avg(dur), 4) AS average_duration FROM l""")
def learning_summary(spark, d):
    log, feedback = execution_log(spark, d)
    return reports.learning_summary(reports.with_feedback(log, feedback))


@register("session_history", "SELECT o_orderkey AS execution_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def session_history(spark, d):
    return reports.session_history(execution_log(spark, d)[0], "1-URGENT").select("execution_id")


# --- triage --------------------------------------------------------------------------------------------------------

# One phrasing per market segment; the numbers and names come from the row.
PHRASES = {
    "AUTOMOBILE": ("Investigate customer C", " above ", " in the last 30 days, high risk"),
    "BUILDING": ("Please check transaction tx", " over ", " from 2024-01-01 to 2024-03-31 in India"),
    "FURNITURE": ("find structuring pattern for account A", " below ", " last month, top 15"),
    "HOUSEHOLD": ("Analyze dataset suspicious activity top ", " more than ", " in Hong Kong and the UAE"),
    "MACHINERY": ("generate dashboard summary for client K", " between 10k and ", " yesterday; dormant account"),
}


def derived_questions(spark, d) -> DataFrame:
    """A question per customer of the driver table."""
    text = None
    for segment, (start, middle, end) in PHRASES.items():
        sentence = F.concat(F.lit(start), F.col("c_custkey"), F.lit(middle), F.abs(F.col("c_acctbal")).cast("int"), F.lit(end))
        text = F.when(F.col("c_mktsegment") == segment, sentence).otherwise(F.lit("hello there") if text is None else text)
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), text.alias("text"))


QUESTIONS = "q AS (SELECT c_custkey AS question_id, CASE c_mktsegment " + " ".join(
    f"WHEN '{s}' THEN concat('{a}', c_custkey, '{b}', CAST(trunc(abs(c_acctbal)) AS INT), '{c}')" for s, (a, b, c) in PHRASES.items()
) + " ELSE 'hello there' END AS text FROM customer)"
TALK = "q AS (SELECT concat(conv_id, ':', turn) AS question_id, text FROM conversations WHERE role = 'user')"


def intent_sql(source: str) -> str:
    shares = []
    for place, (intent, groups) in enumerate(triage.KEYWORDS.items()):
        hits = " + ".join(
            f"CASE WHEN list_has_all(words, [{', '.join(repr(w) for w in words.split())}]) THEN {weight} ELSE 0 END" for weight, words in groups
        )
        shares.append(f"SELECT question_id, '{intent}' AS intent, {place} AS place, least(1.0, CAST({hits} AS DOUBLE) / {sum(w for w, _ in groups)}) AS c FROM w")
    return f"""WITH {source}, w AS (SELECT question_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS words FROM q),
s AS ({' UNION ALL '.join(shares)}),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY c DESC, place) AS n FROM s)
SELECT question_id, CASE WHEN c >= 0.1 THEN intent ELSE 'UNKNOWN' END AS intent, CASE WHEN c >= 0.1 THEN round(c, 4) ELSE 0 END AS intent_confidence FROM b WHERE n = 1"""


@register("intent_scores", intent_sql(QUESTIONS))
def intent_scores(spark, d):
    return triage.intent_scores(derived_questions(spark, d)).select("question_id", "intent", "intent_confidence")


@register("intent_conversations", intent_sql(TALK))
def intent_conversations(spark, d):
    return triage.intent_scores(views.analyst_questions(spark, d)).select("question_id", "intent", "intent_confidence")


@register("entity_extract", f"""WITH {QUESTIONS}
SELECT question_id, array_to_string(regexp_extract_all(text, '{triage.RE_CUSTOMER}', 1), ',') AS customer_ids,
  upper(array_to_string(regexp_extract_all(text, '{triage.RE_TRANSACTION}', 1), ',')) AS transaction_ids,
  array_to_string(regexp_extract_all(text, '{triage.RE_ACCOUNT}', 1), ',') AS account_ids,
  CASE WHEN regexp_extract(text, '{triage.RE_RISK}', 1) = 'high' THEN 'HIGH' END AS risk_level,
  CASE WHEN contains(text, 'structuring') THEN 'structuring' WHEN contains(text, 'dormant account') THEN 'dormant_account' ELSE '' END AS aml_patterns,
  CASE WHEN contains(text, 'Hong Kong') THEN 'Hong Kong,UAE' WHEN contains(text, 'India') THEN 'India' ELSE '' END AS countries,
  CASE WHEN contains(text, 'last 30 days') THEN 'last_30_days' WHEN contains(text, 'from 2024') THEN 'custom_range' WHEN contains(text, 'last month') THEN 'last_month'
       WHEN contains(text, 'yesterday') THEN 'yesterday' END AS date_label,
  coalesce(TRY_CAST(regexp_extract(text, '{triage.RE_LIMIT}', 1) AS INT), -1) AS "limit" FROM q""")
def entity_extract(spark, d):
    rows = triage.entities(derived_questions(spark, d))
    lists = ("customer_ids", "transaction_ids", "account_ids", "aml_patterns", "countries")
    return rows.select("question_id", *[F.array_join(c, ",").alias(c) for c in lists], "risk_level", "date_label",
                       F.coalesce("limit", F.lit(-1)).alias("limit"))


@register("amount_filters", f"""WITH {QUESTIONS}, x AS (SELECT question_id, text, TRY_CAST(regexp_extract(text, '(?:above|over|below|more than|and) ([0-9]+)', 1) AS DOUBLE) AS n FROM q)
SELECT question_id, CASE WHEN contains(text, 'between') THEN 'BETWEEN' WHEN contains(text, 'below') THEN 'BELOW' ELSE 'ABOVE' END AS operator,
  CASE WHEN contains(text, 'between') THEN 10000.0 ELSE n END AS value, CASE WHEN contains(text, 'between') THEN n END AS upper FROM x WHERE n IS NOT NULL""")
def amount_filters(spark, d):
    return triage.entities(derived_questions(spark, d)).select("question_id", F.inline("amounts"))


@register("investigation_types", f"""WITH base AS ({intent_sql(QUESTIONS)}), {QUESTIONS}, x AS (SELECT * FROM base JOIN q USING (question_id))
SELECT question_id, CASE WHEN intent = 'CUSTOMER_INVESTIGATION' THEN 'CUSTOMER_INVESTIGATION' WHEN intent = 'TRANSACTION_INVESTIGATION' THEN 'TRANSACTION_INVESTIGATION'
  WHEN intent = 'AML_PATTERN_SEARCH' THEN 'STRUCTURING_INVESTIGATION' WHEN intent = 'DASHBOARD_SUMMARY' THEN 'RISK_SUMMARY'
  WHEN intent = 'HIGH_RISK_CUSTOMER' THEN 'HIGH_RISK_CUSTOMER_REVIEW'
  WHEN intent = 'DATASET_ANALYSIS' THEN 'TOP_N_INVESTIGATION' ELSE 'CUSTOM_INVESTIGATION' END AS investigation,
  round(greatest(0.0, intent_confidence - CASE WHEN intent = 'DATASET_ANALYSIS' AND contains(text, 'top 0 ') THEN 0.05 ELSE 0.0 END), 4) AS confidence_score FROM x""")
def investigation_types(spark, d):
    return triage.triage(derived_questions(spark, d)).select("question_id", "investigation", "confidence_score")
