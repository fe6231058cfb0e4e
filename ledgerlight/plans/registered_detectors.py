"""Every detector on rows where it fires: feature columns derived from whole order lines, next to plain SQL predicates.

The real features of the driver tables leave many detectors silent (no transaction has eight others within the hour).
Here each line carries feature values that follow from its keys and price, so every predicate, severity and score is
compared on rows inside and outside its limits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import detectors
from ledgerlight.plans.registered import register
from ledgerlight.sources import driver_views as views

K = "(l_orderkey * 7 + l_partkey * 3 + l_suppkey * 11 + l_linenumber * 13)"
J = "(l_orderkey + l_partkey * 5 + l_suppkey * 17 + l_linenumber * 3)"


def part(source: str, modulus: int, scale: float = 1.0, shift: int = 0) -> str:
    return f"(CAST({source} % {modulus} AS DOUBLE) - {shift}) / {scale}"


def whole(source: str, modulus: int) -> str:
    return f"CAST({source} % {modulus} AS BIGINT)"


def one_in(source: str, modulus: int) -> str:
    return f"({source} % {modulus} = 0)"


COLUMNS = {
    "transaction_id": K, "customer_id": "l_suppkey", "transaction_amount": "CAST(l_extendedprice AS DOUBLE)", "customer_average_amount": part(J, 50, 0.01),
    "large_transaction_flag": one_in(K, 11), "amount_z_score": part(J, 97, 10, 30), "transactions_last_hour": whole(K, 12),
    "transactions_last_day": whole(J, 23), "behaviour_deviation_score": part(K, 101, 100), "outside_business_hours": one_in(J, 3),
    "outside_preferred_hour": one_in(K, 5), "new_beneficiary": one_in(J, 4), "beneficiary_is_high_frequency": one_in(K, 6),
    "beneficiary_transaction_count": whole(J, 19), "new_device": one_in(K, 7), "device_switch_flag": one_in(J, 8), "new_country": one_in(K, 9),
    "cross_border_transaction": one_in(J, 10), "high_risk_country_flag": one_in(K, 13), "pep_flag": one_in(J, 14),
    "previous_sar_count": f"CASE WHEN {K} % 15 > 12 THEN 1 ELSE 0 END", "profile_dormant_customer": one_in(J, 16),
    "profile_cash_withdrawal_ratio": part(K, 41, 100), "profile_deposit_ratio": part(J, 31, 100), "outside_preferred_channel": one_in(K, 17),
    "amount_percentile": part(J, 103, 100), "rolling_average_amount": part(K, 7, 0.0005), "rolling_std_amount": part(J, 5, 0.001),
    "profile_avg_daily_txns": part(K, 4, 0.5), "time_since_previous_transaction": part(J, 29, 20), "average_gap_between_transactions": part(K, 37),
    "historical_max_amount": part(J, 3, 0.00004), "historical_min_amount": part(K, 2, 0.0001), "has_profile": one_in(J, 2),
    "hour_of_day": whole(K, 24), "profile_preferred_hour": whole(J, 21), "profile_business_hours_ratio": part(K, 100, 100),
    "unusual_weekday": one_in(J, 18), "profile_weekend_ratio": part(K, 12, 100), "frequency_deviation_score": part(J, 89, 88),
    "amount_deviation_score": part(K, 83, 82), "profile_unique_beneficiaries": whole(J, 10), "profile_avg_monthly_txns": part(K, 25),
    "geographic_change": one_in(K, 4), "profile_transfer_ratio": part(J, 71, 70), "unique_devices_last_30_days": whole(K, 5),
    "profile_cash_intensive_customer": one_in(J, 20), "amount_ratio_to_average": part(K, 61, 10),
}
VIEW = "v AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM lineitem)"

RULES = {
    "R001": ("'HIGH'", 80, "large_transaction_flag"), "R002": ("'MEDIUM'", 60, "amount_z_score > 3"),
    "R003": ("'HIGH'", 75, "transactions_last_hour >= 5 OR transactions_last_day >= 15"), "R004": ("'MEDIUM'", 65, "behaviour_deviation_score > 0.7"),
    "R005": ("'LOW'", 20, "outside_business_hours"), "R006": ("'LOW'", 20, "outside_preferred_hour"), "R007": ("'LOW'", 30, "new_beneficiary"),
    "R008": ("'MEDIUM'", 40, "beneficiary_is_high_frequency"), "R009": ("'MEDIUM'", 50, "new_device"), "R010": ("'MEDIUM'", 45, "device_switch_flag"),
    "R011": ("'HIGH'", 70, "new_country"), "R012": ("'MEDIUM'", 55, "cross_border_transaction"), "R013": ("'CRITICAL'", 95, "high_risk_country_flag"),
    "R014": ("'HIGH'", 85, "pep_flag"), "R015": ("'CRITICAL'", 90, "previous_sar_count > 0"),
    "R016": ("'HIGH'", 80, "profile_dormant_customer AND (transactions_last_day >= 3 OR amount_z_score > 2)"),
    "R017": ("'CRITICAL'", 95, "transaction_amount >= 8000 AND transaction_amount < 10000 AND transactions_last_day >= 3"),
    "R018": ("'HIGH'", 75, "profile_cash_withdrawal_ratio + profile_deposit_ratio > 0.5 AND amount_z_score > 2"), "R019": ("'LOW'", 25, "outside_preferred_channel"),
}
STATISTICS = {
    "S001": ("CASE WHEN abs(amount_z_score) > 4.5 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN abs(amount_z_score) > 4.5 THEN 75 ELSE 50 END", "abs(amount_z_score) > 3"),
    "S002": ("'MEDIUM'", 60, "amount_percentile > 0.95"),
    "S003": ("'MEDIUM'", 65, "CASE WHEN rolling_average_amount > 0 THEN transaction_amount / rolling_average_amount > 2 END"),
    "S004": ("'HIGH'", 70, "CASE WHEN rolling_average_amount > 0 AND rolling_std_amount > 0 THEN (transaction_amount - rolling_average_amount) / rolling_std_amount > 2.5 END"),
    "S005": ("'HIGH'", 80, "CASE WHEN profile_avg_daily_txns > 0 THEN transactions_last_day / profile_avg_daily_txns > 3 END"),
    "S006": ("'CRITICAL'", 90, "CASE WHEN profile_avg_daily_txns > 0 THEN transactions_last_hour / (profile_avg_daily_txns / 24) > 5 END AND transactions_last_hour >= 3"),
    "S007": ("'MEDIUM'", 60, "CASE WHEN time_since_previous_transaction > 0 AND average_gap_between_transactions > 0 THEN time_since_previous_transaction / average_gap_between_transactions < 0.1 END"),
    "S008": ("'HIGH'", 75, "behaviour_deviation_score > 0.75"),
    "S009": ("CASE WHEN historical_max_amount > 0 AND transaction_amount > historical_max_amount THEN 'HIGH' ELSE 'LOW' END",
             "CASE WHEN historical_max_amount > 0 AND transaction_amount > historical_max_amount THEN 85 ELSE 30 END",
             "(historical_max_amount > 0 AND transaction_amount > historical_max_amount) OR (historical_min_amount > 0 AND transaction_amount < historical_min_amount)"),
}
NARROW = "profile_unique_beneficiaries < 3 AND profile_avg_monthly_txns > 10"
BEHAVIOUR = {
    "B001": ("'LOW'", 25, "has_profile AND outside_preferred_hour"), "B002": ("'MEDIUM'", 40, "profile_business_hours_ratio > 0.9 AND outside_business_hours"),
    "B003": ("'MEDIUM'", 45, "unusual_weekday AND profile_weekend_ratio < 0.05"), "B004": ("'HIGH'", 75, "frequency_deviation_score > 0.5"),
    "B005": ("'HIGH'", 70, "amount_deviation_score > 0.6"),
    "B006": (f"CASE WHEN {NARROW} THEN 'MEDIUM' ELSE 'LOW' END", f"CASE WHEN {NARROW} THEN 60 ELSE 30 END", "new_beneficiary"),
    "B007": ("CASE WHEN device_switch_flag THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN device_switch_flag THEN 70 ELSE 50 END", "device_switch_flag OR new_device"),
    "B008": ("'MEDIUM'", 50, "has_profile AND outside_preferred_channel"), "B009": ("'HIGH'", 80, "new_country"),
}
PATTERNS = {
    "P001": ("'CRITICAL'", 0, "transaction_amount >= 8000 AND transaction_amount < 10000 AND transactions_last_day >= 3"),
    "P002": ("'HIGH'", 0, "time_since_previous_transaction < 0.5 AND transactions_last_hour >= 2 AND (NOT has_profile OR profile_transfer_ratio > 0.5)"),
    "P003": ("'CRITICAL'", 0, "transactions_last_day > 5 AND profile_unique_beneficiaries > 5"),
    "P004": ("'HIGH'", 0, "beneficiary_is_high_frequency AND beneficiary_transaction_count > 10 AND time_since_previous_transaction < 1"),
    "P005": ("'HIGH'", 0, "transactions_last_hour >= 5 AND new_beneficiary"), "P006": ("'HIGH'", 0, "transactions_last_day >= 15 AND amount_deviation_score < 0.2"),
    "P007": ("'HIGH'", 0, "profile_dormant_customer AND (transactions_last_day >= 2 OR amount_z_score > 1.5)"),
    "P008": ("'CRITICAL'", 0, "cross_border_transaction AND geographic_change AND transactions_last_day >= 3"), "P009": ("'CRITICAL'", 0, "high_risk_country_flag"),
    "P010": ("'HIGH'", 0, "profile_cash_intensive_customer AND (large_transaction_flag OR amount_z_score > 2)"),
    "P011": ("'MEDIUM'", 0, "device_switch_flag AND unique_devices_last_30_days >= 3"),
    "P012": ("'HIGH'", 0, "beneficiary_is_high_frequency AND beneficiary_transaction_count > 15"),
    "P013": ("'CRITICAL'", 0, "transactions_last_hour >= 8 AND time_since_previous_transaction < 0.1"),
    "P014": ("'HIGH'", 0, "amount_ratio_to_average > 3 AND amount_percentile > 0.95"),
}


def expected(table: dict, composite: str | None, score: int) -> str:
    """Rows (transaction_id, id, severity, score) of a family, with its composite from three severe findings on."""
    numbered = f"{VIEW}, n AS (SELECT *, row_number() OVER () AS n FROM v)"
    single = " UNION ALL ".join(
        f"SELECT n, transaction_id, '{i}' AS id, {severity} AS severity, CAST({points} AS DOUBLE) AS score FROM n WHERE {when}" for i, (severity, points, when) in table.items()
    )
    last = f"SELECT transaction_id, '{composite}', 'CRITICAL', CAST({score} AS DOUBLE) FROM f WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY n, transaction_id HAVING count(*) >= 3"
    return f"WITH {numbered}, f AS ({single}) SELECT transaction_id, id, severity, score FROM f UNION ALL {last}"


def fired(spark, folder, step, column: str):
    rows = views.table(spark, folder, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()])
    return detectors.findings_long(step(rows), column).select("transaction_id", "id", "severity", F.col("score").cast("double").alias("score"))


@register("all_rules_fire", expected(RULES, "R020", 100))
def all_rules_fire(spark, d):
    return fired(spark, d, detectors.rule_hits, "rule_hits")


@register("all_statistics_fire", expected(STATISTICS, "S010", 95))
def all_statistics_fire(spark, d):
    return fired(spark, d, detectors.statistical_findings, "statistical_findings")


@register("all_behaviours_fire", expected(BEHAVIOUR, "B010", 95))
def all_behaviours_fire(spark, d):
    return fired(spark, d, detectors.behaviour_findings, "behaviour_findings")


@register("all_patterns_fire", expected(PATTERNS, "P015", 0))
def all_patterns_fire(spark, d):
    return fired(spark, d, detectors.pattern_findings, "pattern_findings")
