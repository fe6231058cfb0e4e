"""Small hand-made inputs."""

import datetime as dt
import math

from pyspark.sql import types as T

START = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


VECTOR = {
    "transaction_id": "TXN1", "customer_id": "C1", "timestamp": at(10), "amount": 105.0, "transaction_amount": 105.0,
    "customer_average_amount": 100.0, "customer_std_amount": 20.0, "historical_max_amount": 200.0,
    "historical_min_amount": 50.0, "historical_average_amount": 100.0, "amount_ratio_to_average": 1.05,
    "amount_z_score": 0.25, "amount_percentile": 0.5, "large_transaction_flag": False,
    "time_since_previous_transaction": 24.0, "transactions_last_hour": 1, "transactions_last_day": 1,
    "rolling_average_amount": 100.0, "rolling_std_amount": 20.0, "average_gap_between_transactions": 24.0,
    "outside_business_hours": False, "outside_preferred_hour": False, "unusual_weekday": False, "unusual_month": False,
    "amount_deviation_score": 0.05, "frequency_deviation_score": 0.2, "behaviour_deviation_score": 0.08,
    "new_beneficiary": False, "beneficiary_frequency": 5, "beneficiary_transaction_count": 5,
    "beneficiary_is_high_frequency": False, "new_device": False, "device_frequency": 5, "device_switch_flag": False,
    "unique_devices_last_30_days": 1, "new_country": False, "country_frequency": 5, "geographic_change": False,
    "cross_border_transaction": False, "high_risk_country_flag": False, "channel_frequency": 5,
    "outside_preferred_channel": False, "pep_flag": False, "previous_sar_count": 0, "has_profile": True,
    "profile_preferred_hour": 10, "profile_avg_daily_txns": 1.0, "profile_avg_monthly_txns": 30.0,
    "profile_business_hours_ratio": 0.8, "profile_weekend_ratio": 0.2, "profile_cash_withdrawal_ratio": 0.0,
    "profile_deposit_ratio": 0.0, "profile_transfer_ratio": 0.1, "profile_unique_beneficiaries": 5,
    "profile_dormant_customer": False, "profile_cash_intensive_customer": False,
}
KINDS = {str: T.StringType(), float: T.DoubleType(), int: T.LongType(), bool: T.BooleanType(), dt.datetime: T.TimestampType()}


def vectors(spark, *changes: dict):
    """Normal feature rows with changes, numbered TXN1, TXN2, …"""
    schema = T.StructType([T.StructField(k, KINDS[type(v)]) for k, v in VECTOR.items()])
    rows = []
    for i, change in enumerate(changes, 1):
        merged = VECTOR | {"transaction_id": f"TXN{i}"} | change
        if merged["has_profile"] is False:
            merged |= {k: None for k in VECTOR if k.startswith("profile_")}
        rows.append(tuple(merged[k] for k in VECTOR))
    return spark.createDataFrame(rows, schema)


def ids_by_row(df, column):
    return {r.transaction_id: [f["id"] for f in r[column]] for r in df.select("transaction_id", column).collect()}


def same_rows(left, right, key, digits=6):
    """Frames with equal rows up to rounding, regardless of order."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def norm(row):
        out = []
        for c in columns:
            v = row[c]
            out.append(None if isinstance(v, float) and math.isnan(v) else round(v, digits) + 0.0 if isinstance(v, float) else v)
        return tuple(out)

    a = {r[key]: norm(r) for r in left.collect()}
    b = {r[key]: norm(r) for r in right.collect()}
    assert a.keys() == b.keys()
    wrong = [(k, [(c, x, y) for c, x, y in zip(columns, a[k], b[k]) if x != y]) for k in a if a[k] != b[k]]
    assert not wrong, wrong[:3]
