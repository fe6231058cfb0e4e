"""Four detector families as declarative lists of column predicates.

A detector is (id, name, severity, score, predicate, …) in SQL text, so a family is parsed by Spark as
one expression. It becomes one narrow projection giving ``array<struct>`` on the transaction row; ``findings_long`` turns it into rows.
Input is the frame of :func:`ledgerlight.operators.features.build_features`. Predicates over an
absent profile are null and therefore do not fire.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.operators.ordered import exact_quantiles

FAMILIES = ("rule", "behaviour", "statistical", "ml", "pattern")


@dataclass(frozen=True)
class Detector:
    """One detector; ``severity``, ``score``, ``when``, ``deviation`` and ``confidence`` are SQL.

    ``severity`` may be a bare word. Without a ``confidence`` the family's formula applies.
    """

    id: str
    name: str
    severity: str
    score: str | float
    when: str
    reason: str = ""
    deviation: str = "0"
    confidence: str | float | None = None
    evidence: Sequence[str] = ()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def severity(d: Detector) -> str:
    return quoted(d.severity) if d.severity.isupper() and d.severity.isalpha() else d.severity


def finding(d: Detector, base: float, slope: float) -> str:
    """The common struct of all families.

    Confidence grows with the deviation, ``min(1, base + slope * deviation)``, or is 0.8 without one.
    """
    deviation = f"cast({d.deviation} as double)"
    trust = d.confidence
    if trust is None:
        trust = f"round(case when {deviation} > 0 then least(1.0D, {base}D + {slope}D * {deviation}) else 0.8D end, 2)"
    pairs = ", ".join(f"{quoted(e)}, cast({e} as string)" for e in d.evidence)
    evidence = f"map({pairs})" if pairs else "cast(map() as map<string,string>)"
    return (
        f"named_struct('id', {quoted(d.id)}, 'name', {quoted(d.name)}, 'severity', {severity(d)}, "
        f"'score', cast({d.score} as double), 'confidence', cast({trust} as double), 'deviation', {deviation}, "
        f"'reason', {quoted(d.reason)}, 'evidence', {evidence})"
    )


def detect(
    df: DataFrame, column: str, detectors: Sequence[Detector], composite: Detector | None, base: float, slope: float, minimum: int
) -> DataFrame:
    """Add ``column``: found structs in list order, then the composite when enough of them are severe.

    Structs are put together by ``concat``, which is compiled; inside a higher-order function Spark would interpret every one.
    """
    cases = ", ".join(f"case when {d.when} then array({finding(d, base, slope)}) else array() end" for d in detectors)
    levels = ", ".join(f"case when {d.when} then {severity(d)} end" for d in detectors)
    counted = df.withColumns(
        {column: F.expr(f"concat({cases})"), "_severe": F.expr(f"size(filter(array({levels}), s -> s in ('HIGH', 'CRITICAL')))")}
    )
    if composite is None:
        return counted.drop("_severe")
    last = f"case when _severe >= {minimum} then array({finding(composite, base, slope)}) end"
    return counted.withColumn(column, F.expr(f"coalesce(concat({column}, {last}), {column})")).drop("_severe")


# Fixed values in the four lists below: ids, names, severities, scores and limits of the detectors.

# --- rules ---------------------------------------------------------------------------------------------


def rules(cfg: EngineConfig) -> list[Detector]:
    near_limit = f"transaction_amount >= {cfg.structuring_low}D and transaction_amount < {cfg.structuring_high}D"
    cash = "profile_cash_withdrawal_ratio + profile_deposit_ratio"
    return [
        Detector("R001", "Large Transaction", "HIGH", 80, "large_transaction_flag",
                 "amount far above the customer's history", evidence=["transaction_amount", "customer_average_amount"]),
        Detector("R002", "Large Z-Score", "MEDIUM", 60, f"amount_z_score > {cfg.z_score}D",
                 "amount is an outlier of its distribution", evidence=["amount_z_score"]),
        Detector("R003", "Rapid Transaction Velocity", "HIGH", 75,
                 f"transactions_last_hour >= {cfg.velocity_hour} or transactions_last_day >= {cfg.velocity_day}",
                 "many transactions in a short time", evidence=["transactions_last_hour", "transactions_last_day"]),
        Detector("R004", "Behaviour Deviation", "MEDIUM", 65, f"behaviour_deviation_score > {cfg.rule_deviation}D",
                 "strong deviation from the profile", evidence=["behaviour_deviation_score"]),
        Detector("R005", "Outside Business Hours", "LOW", 20, "outside_business_hours", "outside 9 to 17 o'clock"),
        Detector("R006", "Outside Preferred Hour", "LOW", 20, "outside_preferred_hour", "not the usual hour"),
        Detector("R007", "New Beneficiary", "LOW", 30, "new_beneficiary", "first payment to this counterparty"),
        Detector("R008", "High Frequency Beneficiary", "MEDIUM", 40, "beneficiary_is_high_frequency",
                 "frequent payments to one counterparty", evidence=["beneficiary_transaction_count"]),
        Detector("R009", "New Device", "MEDIUM", 50, "new_device", "device not seen before"),
        Detector("R010", "Device Switch", "MEDIUM", 45, "device_switch_flag", "other device than last time"),
        Detector("R011", "New Country", "HIGH", 70, "new_country", "first payment to this country"),
        Detector("R012", "Cross Border Transaction", "MEDIUM", 55, "cross_border_transaction", "crosses a border"),
        Detector("R013", "High Risk Country", "CRITICAL", 95, "high_risk_country_flag", "high-risk jurisdiction"),
        Detector("R014", "PEP Customer", "HIGH", 85, "pep_flag", "politically exposed customer"),
        Detector("R015", "Previous SAR History", "CRITICAL", 90, f"previous_sar_count > {cfg.sar_count}",
                 "earlier suspicious activity reports", evidence=["previous_sar_count"]),
        Detector("R016", "Dormant Account Reactivation", "HIGH", 80,
                 "profile_dormant_customer and (transactions_last_day >= 3 or amount_z_score > 2.0D)",
                 "dormant customer became active", evidence=["transactions_last_day"]),
        Detector("R017", "Structuring Indicator", "CRITICAL", 95,
                 f"{near_limit} and transactions_last_day >= {cfg.structuring_per_day}",
                 "repeated amounts just under the reporting limit",
                 evidence=["transaction_amount", "transactions_last_day"]),
        Detector("R018", "Cash Intensive Behaviour", "HIGH", 75, f"{cash} > {cfg.cash_ratio}D and amount_z_score > 2.0D",
                 "large amount for a cash-intensive customer"),
        Detector("R019", "Channel Anomaly", "LOW", 25, "outside_preferred_channel", "not the preferred channel"),
    ]


def rule_hits(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    composite = Detector("R020", "Multiple High Risk Signals", "CRITICAL", 100, "true", "three or more severe rules")
    return detect(df, "rule_hits", rules(cfg), composite, 0.8, 0.0, 3)


# --- statistics ------------------------------------------------------------------------------------------


def statistics(cfg: EngineConfig) -> list[Detector]:
    # divisors are guarded, so that strict (ANSI) sessions do not fail on a zero
    far = f"abs(amount_z_score) > {cfg.z_score * 1.5}D"
    ratio = "transaction_amount / nullif(rolling_average_amount, 0)"
    spread = "(transaction_amount - rolling_average_amount) / nullif(rolling_std_amount, 0)"
    per_day = "transactions_last_day / nullif(profile_avg_daily_txns, 0)"
    per_hour = "transactions_last_hour / nullif(profile_avg_daily_txns / 24, 0)"
    gap_share = "time_since_previous_transaction / nullif(average_gap_between_transactions, 0)"
    above = "historical_max_amount > 0 and transaction_amount > historical_max_amount"
    below = "historical_min_amount > 0 and transaction_amount < historical_min_amount"
    return [
        Detector("S001", "Amount Z-Score", f"if({far}, 'HIGH', 'MEDIUM')", f"if({far}, 75, 50)",
                 f"abs(amount_z_score) > {cfg.z_score}D", "amount many deviations from the mean", "amount_z_score",
                 evidence=["amount_z_score"]),
        Detector("S002", "Amount Percentile", "MEDIUM", 60, f"amount_percentile > {cfg.percentile}D",
                 "among the customer's largest amounts", f"amount_percentile - {cfg.percentile}D",
                 evidence=["amount_percentile"]),
        Detector("S003", "Rolling Mean Deviation", "MEDIUM", 65,
                 f"rolling_average_amount > 0 and {ratio} > {cfg.rolling_mean_ratio}D", "multiple of the recent mean",
                 f"{ratio} - 1.0D", evidence=["rolling_average_amount"]),
        Detector("S004", "Rolling Standard Deviation", "HIGH", 70,
                 f"rolling_average_amount > 0 and rolling_std_amount > 0 and {spread} > {cfg.rolling_std_multiple}D",
                 "many recent deviations above the mean", spread,
                 evidence=["rolling_average_amount", "rolling_std_amount"]),
        Detector("S005", "Transaction Frequency Spike", "HIGH", 80, f"{per_day} > {cfg.frequency_multiple}D",
                 "far more transactions than usual per day", per_day, evidence=["transactions_last_day"]),
        Detector("S006", "Velocity Spike", "CRITICAL", 90,
                 f"{per_hour} > {cfg.hourly_multiple}D and transactions_last_hour >= 3", "sudden acceleration", per_hour,
                 evidence=["transactions_last_hour"]),
        Detector("S007", "Time Gap Outlier", "MEDIUM", 60,
                 f"time_since_previous_transaction > 0 and average_gap_between_transactions > 0 and {gap_share} < {cfg.gap_ratio}D",
                 "much shorter gap than usual",
                 "average_gap_between_transactions / nullif(time_since_previous_transaction, 0)",
                 evidence=["time_since_previous_transaction", "average_gap_between_transactions"]),
        Detector("S008", "Behaviour Deviation", "HIGH", 75, f"behaviour_deviation_score > {cfg.stat_deviation}D",
                 "abnormal composite deviation", "behaviour_deviation_score", evidence=["behaviour_deviation_score"]),
        Detector("S009", "Historical Range Violation", f"if({above}, 'HIGH', 'LOW')", f"if({above}, 85, 30)",
                 f"({above}) or ({below})", "outside the historical range",
                 f"if({above}, transaction_amount - historical_max_amount, historical_min_amount - transaction_amount)",
                 evidence=["historical_min_amount", "historical_max_amount"]),
    ]


def statistical_findings(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    composite = Detector("S010", "Composite Statistical Outlier", "CRITICAL", 95, "true",
                         "several severe statistical anomalies", "_severe")
    return detect(df, "statistical_findings", statistics(cfg), composite, 0.5, 0.05, cfg.composite_hits)


# --- behaviour -----------------------------------------------------------------------------------------------


def behaviours(df: DataFrame, cfg: EngineConfig) -> list[Detector]:
    hour = "hour_of_day" if "hour_of_day" in df.columns else "hour(timestamp)"
    apart = f"abs({hour} - profile_preferred_hour)"
    narrow = "coalesce(profile_unique_beneficiaries < 3 and profile_avg_monthly_txns > 10, false)"
    return [
        Detector("B001", "Preferred Hour Deviation", "LOW", 25, "has_profile and outside_preferred_hour",
                 "hours away from the preferred hour", f"least({apart}, 24 - {apart})"),
        Detector("B002", "Business Hour Deviation", "MEDIUM", 40,
                 "profile_business_hours_ratio > 0.9D and outside_business_hours", "usually within business hours", "1"),
        Detector("B003", "Weekend Behaviour Change", "MEDIUM", 45,
                 "unusual_weekday and profile_weekend_ratio < 0.05D", "rarely active on weekends", "1"),
        Detector("B004", "Frequency Behaviour Change", "HIGH", 75,
                 f"frequency_deviation_score > {cfg.frequency_deviation}D", "abnormal rate", "frequency_deviation_score"),
        Detector("B005", "Amount Behaviour Change", "HIGH", 70, f"amount_deviation_score > {cfg.amount_deviation}D",
                 "abnormal amount", "amount_deviation_score"),
        Detector("B006", "Beneficiary Behaviour Change", f"if({narrow}, 'MEDIUM', 'LOW')", f"if({narrow}, 60, 30)",
                 "new_beneficiary", "new counterparty", f"if({narrow}, 1.0D, 0.5D)"),
        Detector("B007", "Device Behaviour Change", "if(device_switch_flag, 'HIGH', 'MEDIUM')",
                 "if(device_switch_flag, 70, 50)", "device_switch_flag or new_device", "new or switched device", "1"),
        Detector("B008", "Channel Behaviour Change", "MEDIUM", 50, "has_profile and outside_preferred_channel",
                 "other channel than preferred", "1"),
        Detector("B009", "Country Behaviour Change", "HIGH", 80, "new_country", "country not used before", "1"),
    ]


def behaviour_findings(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    composite = Detector("B010", "Composite Behaviour Anomaly", "CRITICAL", 95, "true",
                         "several severe changes of behaviour", "_severe")
    return detect(df, "behaviour_findings", behaviours(df, cfg), composite, 0.7, 0.1, cfg.composite_hits)


# --- patterns --------------------------------------------------------------------------------------------------


def patterns(cfg: EngineConfig) -> list[Detector]:
    near_limit = f"transaction_amount >= {cfg.structuring_low}D and transaction_amount < {cfg.structuring_high}D"
    return [
        Detector("P001", "Structuring / Smurfing", "CRITICAL", 0,
                 f"{near_limit} and transactions_last_day >= {cfg.structuring_per_day}",
                 "repeated amounts under the reporting limit", confidence=0.95,
                 evidence=["transaction_amount", "transactions_last_day"]),
        Detector("P002", "Rapid Movement of Funds", "HIGH", 0,
                 "time_since_previous_transaction < 0.5D and transactions_last_hour >= 2 "
                 "and if(has_profile, profile_transfer_ratio > 0.5D, true)",
                 "funds moved on at once", confidence=0.85, evidence=["transactions_last_hour"]),
        Detector("P003", "Layering", "CRITICAL", 0, "transactions_last_day > 5 and profile_unique_beneficiaries > 5",
                 "rapid transfers over many counterparties", confidence=0.90, evidence=["transactions_last_day"]),
        Detector("P004", "Circular Transactions", "HIGH", 0,
                 "beneficiary_is_high_frequency and beneficiary_transaction_count > 10 and time_since_previous_transaction < 1.0D",
                 "repeated rapid transfers in a small circle", confidence=0.80,
                 evidence=["beneficiary_transaction_count"]),
        Detector("P005", "Fan-Out", "HIGH", 0, "transactions_last_hour >= 5 and new_beneficiary",
                 "rapid spread to new counterparties", confidence=0.85, evidence=["transactions_last_hour"]),
        Detector("P006", "Fan-In", "HIGH", 0, "transactions_last_day >= 15 and amount_deviation_score < 0.2D",
                 "many similar transactions in one day", confidence=0.75, evidence=["transactions_last_day"]),
        Detector("P007", "Dormant Account Reactivation", "HIGH", 0,
                 "profile_dormant_customer and (transactions_last_day >= 2 or amount_z_score > 1.5D)",
                 "dormant customer became active", confidence=0.90, evidence=["transactions_last_day", "amount_z_score"]),
        Detector("P008", "Cross-Border Layering", "CRITICAL", 0,
                 "cross_border_transaction and geographic_change and transactions_last_day >= 3",
                 "rapid movement over several borders", confidence=0.95, evidence=["transactions_last_day"]),
        Detector("P009", "High-Risk Geography Pattern", "CRITICAL", 0, "high_risk_country_flag",
                 "activity in a high-risk jurisdiction", confidence=0.98),
        Detector("P010", "Cash Intensive Behaviour", "HIGH", 0,
                 "profile_cash_intensive_customer and (large_transaction_flag or amount_z_score > 2.0D)",
                 "large amount in a cash-intensive profile", confidence=0.85),
        Detector("P011", "Shared Device Pattern", "MEDIUM", 0,
                 "device_switch_flag and unique_devices_last_30_days >= 3", "several devices in turn",
                 confidence=0.80, evidence=["unique_devices_last_30_days"]),
        Detector("P012", "Shared Beneficiary Pattern", "HIGH", 0,
                 "beneficiary_is_high_frequency and beneficiary_transaction_count > 15",
                 "volume funnelled to one counterparty", confidence=0.85, evidence=["beneficiary_transaction_count"]),
        Detector("P013", "Burst Activity", "CRITICAL", 0,
                 f"transactions_last_hour >= {cfg.burst_per_hour} and time_since_previous_transaction < {cfg.burst_gap_hours}D",
                 "burst within minutes", confidence=0.95, evidence=["transactions_last_hour"]),
        Detector("P014", "Escalating Transaction Amounts", "HIGH", 0,
                 f"amount_ratio_to_average > {cfg.escalating_ratio}D and amount_percentile > 0.95D",
                 "amounts keep growing", confidence=0.90, evidence=["amount_ratio_to_average", "amount_percentile"]),
    ]


def pattern_findings(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    composite = Detector("P015", "Composite AML Pattern", "CRITICAL", 0, "true", "several severe typologies",
                         confidence=1.0)
    return detect(df, "pattern_findings", patterns(cfg), composite, 0.8, 0.0, 3)


def all_findings(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The four rule-like families side by side; no shuffle."""
    for step in (rule_hits, behaviour_findings, statistical_findings, pattern_findings):
        df = step(df, cfg)
    return df


def findings_long(df: DataFrame, column: str) -> DataFrame:
    """(transaction_id, customer_id, finding columns), one row per finding.

    A plain ``inline`` has Spark filter for found arrays first, below the projections, so that all detectors run again.
    """
    return df.select("transaction_id", "customer_id", F.inline_outer(column)).where(F.col("id").isNotNull())


def round_amount_scenario(df: DataFrame) -> DataFrame:
    """50 points and the scenario name for amounts that are multiples of 1,000, capped at 100."""
    is_round = F.coalesce(F.col("amount") % 1000 == 0, F.lit(False))
    return df.withColumns(
        {
            "is_round_amount": is_round.cast("int"),
            "round_amount_score": F.least(F.lit(100.0), F.when(is_round, 50.0).otherwise(0.0)),
            "round_amount_scenario": F.when(is_round, "Round-Amount"),
        }
    )


def iqr_outliers(df: DataFrame, value: str, cfg: EngineConfig = EngineConfig(), keys: Sequence[str] = ()) -> DataFrame:
    """Rows outside Tukey's fence over the whole table, or over each group of ``keys`` (rows without a group have no fence).

    Quartiles are found from counts of values, so no group is held in one task; those of groups are joined, as many rows as
    there are groups.
    """
    wanted, v = {"q1": 0.25, "q3": 0.75}, F.col(value)
    if not keys:
        row = exact_quantiles(df, [], value, wanted, cfg).first()
        if row is None:
            return df.where(F.lit(False))
        reach = cfg.iqr_multiple * (row.q3 - row.q1)
        return df.where((v < row.q1 - reach) | (v > row.q3 + reach))
    fences = exact_quantiles(df, keys, value, wanted, cfg)
    reach = cfg.iqr_multiple * (F.col("q3") - F.col("q1"))
    fences = fences.select(*keys, (F.col("q1") - reach).alias("_low"), (F.col("q3") + reach).alias("_high"))
    return df.join(fences, list(keys)).where((v < F.col("_low")) | (v > F.col("_high"))).select(*df.columns)
