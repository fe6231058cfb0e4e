import datetime as dt
import random

import pandas as pd
import pytest

from ledgerlight import EngineConfig
from ledgerlight.functions.timeparts import DAY
from ledgerlight.operators import features, ordered, profiles
from tests.helpers import START, at, same_rows

HOT = EngineConfig(hot_key_rows=40, slice_rows=7)


def sample(spark, n=160, seed=3):
    """One customer with half of the rows, ties in time and null keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        customer = "BIG" if rng.random() < 0.5 else f"C{rng.randint(1, 6)}"
        when = START + dt.timedelta(minutes=rng.choice([5, 30, 60]) * rng.randint(0, 400))
        rows.append((
            f"T{i:04d}", customer, when, round(rng.uniform(1, 500), 2), rng.choice(["A", "B"]),
            rng.choice(["WEB", "POS", "ATM"]), rng.choice(["X", "Y", "Z", None]), rng.choice(["US", "FR", None]),
            rng.choice(["d1", "d2", "d3", None]),
        ))
    return spark.createDataFrame(
        rows,
        "transaction_id string, customer_id string, timestamp timestamp, amount double, transaction_type string, "
        "channel string, counterparty_account_id string, counterparty_country string, device_id string",
    ).persist()


def test_hot_customers_get_the_same_features(spark):
    rows = sample(spark)
    assert ordered.find_hot_keys(rows, "customer_id", HOT)[0] is not None
    assert ordered.find_hot_keys(rows, "customer_id", EngineConfig()) == (None, False)
    plain = features.build_features(rows, profiles.build_profiles(rows))
    split = features.build_features(rows, profiles.build_profiles(rows, cfg=HOT), HOT)
    same_rows(plain, split, "transaction_id")


def hard(spark):
    """Copied rows, huge, negative, infinite, missing and NaN amounts, customers of every heat and none."""
    rng, rows = random.Random(9), []
    amounts = [5e12, 1e13, -2.5, -1e9, float("nan"), float("inf"), None, 0.1, 123.45, 99.99]
    for i in range(120):
        customer = [None, "A", "A", "B", "C"][min(4, rng.randint(0, 6))]
        amount = rng.choice(amounts) if rng.random() < 0.3 else round(rng.uniform(-50, 500), 2)
        when = START + dt.timedelta(hours=rng.randint(0, 900))
        rows.append((f"T{i:04d}", customer, when, amount, "A", "WEB", rng.choice(["X", "Y", None]), "US", rng.choice(["d1", "d2", None])))
    return spark.createDataFrame(rows + rows[:40], sample(spark, 1).schema)


def everything(df):
    """Rows as text, rounded relatively, without regard to order; numbers of copies are sorted by themselves."""
    def norm(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_hot_way_is_equal_on_hard_amounts(spark):
    rows, small = hard(spark), EngineConfig(hot_key_rows=5, slice_rows=4)
    plain, split = (features.build_features(rows, None, c) for c in (EngineConfig(), small))
    assert plain.count() == rows.count()
    assert everything(plain) == everything(split)
    none = plain.where("customer_id IS NULL")
    assert none.count() > 5 and none.where("amount_z_score IS NOT NULL OR transactions_last_day IS NOT NULL OR new_device").count() == 0
    assert profiles.build_profiles(rows, cfg=small).where("customer_id IS NULL").count() == 0


def test_slices_hold_equal_numbers_of_rows(spark):
    cfg = EngineConfig(slice_rows=500)
    rows = spark.range(20_000).selectExpr("'k' AS k", "IF(id = 7, 1e9, IF(id < 9000, 5 + id / 1e9, id)) AS v")
    sizes = [r["count"] for r in ordered.with_slices(rows, ["k"], "v", cfg).groupBy("_slice").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 1000
    plan = ordered.exact_quantiles(rows, [], "v", {"m": 0.5}, cfg)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan


def test_hot_customers_get_the_same_profiles(spark):
    rows = sample(spark)
    names = ["customer_id", "statistics.*", "confidence_score", "summary"]
    same_rows(profiles.build_profiles(rows).select(names), profiles.build_profiles(rows, cfg=HOT).select(names), "customer_id")


def test_result_does_not_depend_on_partitions(spark):
    rows = sample(spark, 80)
    same_rows(features.build_features(rows.repartition(7)), features.build_features(rows.coalesce(1)), "transaction_id")


def test_velocity_against_brute_force(spark):
    rows = sample(spark)
    got = {r.transaction_id: r for r in features.velocity_features(rows).collect()}
    data = rows.toPandas()
    for r in data.itertuples():
        own = data[data.customer_id == r.customer_id]
        day = own[(own.timestamp <= r.timestamp) & (own.timestamp > r.timestamp - pd.Timedelta("24h"))]
        hour = own[(own.timestamp <= r.timestamp) & (own.timestamp > r.timestamp - pd.Timedelta("1h"))]
        found = got[r.transaction_id]
        assert found.transactions_last_day == len(day) and found.transactions_last_hour == len(hour)
        assert found.amount_last_day == pytest.approx(day.amount.sum())
        assert found.rolling_std_amount == pytest.approx(day.amount.std() if len(day) > 1 else 0.0)


@pytest.mark.parametrize("cfg", [EngineConfig(), HOT])
def test_rolling_distinct_against_brute_force(spark, cfg):
    rows = sample(spark)
    found = ordered.rolling_distinct(rows, "customer_id", "device_id", 2 * DAY, "n", cfg)
    got = {r.transaction_id: r.n for r in found.collect()}
    data = rows.toPandas()
    for r in data.itertuples():
        own = data[(data.customer_id == r.customer_id) & (data.timestamp <= r.timestamp)]
        recent = own[own.timestamp > r.timestamp - pd.Timedelta("2D")]
        assert got[r.transaction_id] == recent.device_id.nunique()


@pytest.mark.parametrize("slice_rows", [3, 50_000])
def test_exact_quantiles(spark, slice_rows):
    rows = sample(spark)
    wanted = {"q25": 0.25, "q50": 0.5, "q99": 0.99}
    got = ordered.exact_quantiles(rows, ["customer_id"], "amount", wanted, EngineConfig(slice_rows=slice_rows)).collect()
    data = rows.toPandas().groupby("customer_id").amount
    for r in got:
        for name, q in wanted.items():
            assert r[name] == pytest.approx(data.quantile(q)[r.customer_id])
    whole = ordered.exact_quantiles(rows, [], "amount", wanted, EngineConfig(slice_rows=slice_rows)).first()
    assert whole.q50 == pytest.approx(rows.toPandas().amount.median())


def test_percentile_rank_averages_ties(spark):
    rows = spark.createDataFrame(
        [("a", "C", at(0), 1.0), ("b", "C", at(1), 2.0), ("c", "C", at(2), 2.0), ("d", "C", at(3), 5.0)],
        "transaction_id string, customer_id string, timestamp timestamp, amount double",
    )
    got = {r.transaction_id: r.amount_percentile for r in features.amount_features(rows).collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0}


def test_first_row_and_defaults(spark):
    rows = spark.createDataFrame(
        [("TXN100", "C", at(10), 500.0)], "transaction_id string, customer_id string, timestamp timestamp, amount double"
    )
    row = features.build_features(rows).first()
    assert row.time_since_previous_transaction == 0.0 and row.transactions_last_day == 1
    assert row.rolling_std_amount == 0.0 and row.kyc_level == "VERIFIED"
    assert not row.new_beneficiary and row.beneficiary_frequency == 1 and row.preferred_channel == "UNKNOWN"


def test_switches_and_high_risk(spark):
    rows = spark.createDataFrame(
        [("t1", "C", at(0), 5.0, "BEN1", "DEV1", "MOBILE", "US", "US", "Normal"),
         ("t2", "C", at(1), 5.0, "BEN2", "DEV2", "WEB", "IR", "US", "Black"),
         ("t3", "C", at(2), 5.0, "BEN2", "DEV2", "MOBILE", None, "US", None)],
        "transaction_id string, customer_id string, timestamp timestamp, amount double, counterparty_account_id string, "
        "device_id string, channel string, counterparty_country string, location_country string, fatf_status string",
    )
    got = {r.transaction_id: r for r in features.build_features(rows).collect()}
    assert got["t1"].new_beneficiary and got["t2"].new_beneficiary and not got["t3"].new_beneficiary
    assert got["t1"].new_device and not got["t1"].device_switch_flag and got["t2"].device_switch_flag
    assert got["t2"].outside_preferred_channel and got["t2"].cross_border_transaction and got["t2"].geographic_change
    # a listed country by status; 'Normal' in any case and unknown countries are not flagged
    assert got["t2"].high_risk_country_flag and not got["t1"].high_risk_country_flag
    assert not got["t3"].high_risk_country_flag and not got["t3"].cross_border_transaction
    assert got["t2"].distance_from_previous_country == 500.0 and got["t3"].unique_devices_last_30_days == 2


def test_profile_of_one_row(spark):
    rows = spark.createDataFrame(
        [("t", "C", at(10), 500.0, "TRANSFER", "MOBILE", "B1", 30)],
        "transaction_id string, customer_id string, timestamp timestamp, amount double, transaction_type string, "
        "channel string, counterparty_account_id string, account_age_days int",
    )
    p = profiles.build_profiles(rows).first()
    s = p.statistics
    assert (s.avg_amount, s.min_amount, s.max_amount, s.std_amount) == (500.0, 500.0, 500.0, 0.0)
    assert s.unique_beneficiaries == 1 and s.most_common_beneficiary == "B1" and s.unique_channels == 1
    assert s.transfer_ratio == 1.0 and p.flags.digital_first_customer and "500.00" in p.summary
    assert p.confidence_score == pytest.approx(0.5 / 50 + 0.3 * 30 / 180 + 0.2, abs=0.01)


def test_as_of_profile_sees_only_earlier_rows(spark):
    rows = sample(spark)
    assert profiles.build_profiles(rows, as_of="2024-01-03").count() <= profiles.build_profiles(rows).count()
    early = rows.where("timestamp < '2024-01-03'")
    same_rows(
        profiles.build_profiles(rows, as_of="2024-01-03").select("customer_id", "statistics.*"),
        profiles.build_profiles(early).select("customer_id", "statistics.*"), "customer_id",
    )


def test_plan_has_one_exchange_by_customer(spark, sf):
    from ledgerlight.sources.driver_views import txn_events

    plan = features.velocity(features.amount_scale(features.with_profile(
        txn_events(spark, sf).withColumn("_us", ordered.micros("timestamp")), None)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
