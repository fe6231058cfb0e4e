"""One behaviour profile per customer: metadata, statistics, flags, confidence and a summary line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.functions.timeparts import with_time_parts
from ledgerlight.operators.features import CUSTOMER, has
from ledgerlight.operators.ordered import Heat, by_heat, exact_quantiles

# Metadata column -> default for customers that never show a value.
METADATA = {
    "account_age_days": 0,
    "customer_age_group": "Unknown",
    "kyc_level": "Unknown",
    "is_pep": False,
    "is_high_risk_country_history": False,
}


def type_ratio(types: tuple[str, ...]) -> Column:
    """Share of a customer's rows whose type is in the list; null types are not counted."""
    return F.count_if(F.col("transaction_type").isin(*types)) / F.nullif(F.count("transaction_type"), F.lit(0))


# column of a few known values -> (name of its mode, first value, last value); counted as one vector in the customer's aggregate
VECTORS = {
    "hour_of_day": ("preferred_hour", 0, 23),
    "day_of_week": ("most_active_weekday", 0, 6),
    "transaction_month": ("most_active_month", 1, 12),
}
# column of any values -> (name of its mode, name of its distinct count); None where a profile does not need one
COUNTED = {
    "transaction_type": ("most_common_txn_type", None),
    "channel": ("most_common_channel", "unique_channels"),
    "counterparty_account_id": ("most_common_beneficiary", "unique_beneficiaries"),
    "account_id": (None, "unique_accounts"),
    "counterparty_country": (None, "unique_countries"),
    "device_id": (None, "unique_devices"),
    "transaction_date": (None, "active_days"),
}


def value_statistics(df: DataFrame) -> DataFrame:
    """Modes (smallest on ties) and distinct counts of all counted columns per customer.

    Values are counted first, (customer, column, value) at a time, so no task holds the values of one customer; several
    distinct counts next to modes in one aggregate would be far slower. Rows that are dealt by customer already are counted
    where they lie: the row a column takes here is never shuffled then.
    """
    kinds = dict(df.dtypes)
    present = [c for c in COUNTED if c in kinds]

    def entry(c: str) -> Column:
        numeric = kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float")
        order = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"), order.alias("place"))

    counts = (
        df.select(CUSTOMER, F.inline(F.array(*[entry(c) for c in present])))
        .where(F.col("value").isNotNull())
        .groupBy(CUSTOMER, "kind", "value", "place")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    out = []
    for c, (mode, distinct) in COUNTED.items():
        mine = F.col("kind") == c
        if mode:
            top = F.min(F.when(mine, F.struct(-F.col("n"), "place", "value")))["value"]
            out.append(F.coalesce(top, F.lit("UNKNOWN")).alias(mode))
        if distinct:
            out.append(F.count_if(mine).alias(distinct))
    return counts.groupBy(CUSTOMER).agg(*out)


def vector_modes() -> dict[str, Column]:
    """Most frequent value of each vector, the smallest on ties, null where nothing was counted."""
    out = {}
    for c, (name, low, _) in VECTORS.items():
        counts, most = F.col(f"_{c}"), F.array_max(f"_{c}")
        out[name] = F.when(most > 0, (F.array_position(counts, most) - 1 + low).cast("int"))
    return out


def _aggregates(df: DataFrame, cfg: EngineConfig) -> list[Column]:
    """Statistics that keep a few numbers per customer."""
    out = [
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.min("amount").alias("min_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_amount"),
        F.count("amount").alias("total_txns"),
        F.avg(F.col("is_business_hours").cast("int")).alias("business_hours_ratio"),
        F.avg(F.col("is_weekend").cast("int")).alias("weekend_ratio"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
    ]
    for c, (_, low, high) in VECTORS.items():
        numbers = [F.count_if(F.col(c) == v) if has(df, c) else F.max(F.lit(0)) for v in range(low, high + 1)]
        out.append(F.array(*numbers).alias(f"_{c}"))
    for types, name in (
        (cfg.cash_types, "cash_withdrawal_ratio"),
        (cfg.deposit_types, "deposit_ratio"),
        (cfg.transfer_types, "transfer_ratio"),
    ):
        ratio = F.coalesce(type_ratio(types), F.lit(0.0)) if has(df, "transaction_type") else F.max(F.lit(0.0))
        out.append(ratio.alias(name))
    for column, default in METADATA.items():
        value = F.coalesce(F.min(column), F.lit(default)) if has(df, column) else F.max(F.lit(default))
        out.append(value.alias(column))
    return out


def profile_statistics(df: DataFrame, cfg: EngineConfig = EngineConfig(), heat: Heat | None = None, shared: bool = False) -> DataFrame:
    """Flat statistics per customer; hot customers get their median from counts of amounts.

    ``shared``: other steps deal the rows of ``df`` by customer as well, so they are dealt whole and made narrow afterwards.
    """

    def narrow(rows: DataFrame) -> DataFrame:
        timed = rows if has(rows, "is_business_hours") else with_time_parts(rows)
        used = {CUSTOMER, "amount", "is_business_hours", "is_weekend", *VECTORS, *COUNTED, *METADATA}
        return timed.select(*[c for c in timed.columns if c in used])

    def regular(cold: DataFrame) -> DataFrame:
        rows = narrow(cold) if shared else cold
        stats = rows.groupBy(CUSTOMER).agg(*_aggregates(rows, cfg), F.median("amount").alias("median_amount"))
        return stats.join(value_statistics(rows), CUSTOMER, "left")

    def skewed(hot: DataFrame, _keys) -> DataFrame:
        rows = narrow(hot) if shared else hot
        stats = rows.groupBy(CUSTOMER).agg(*_aggregates(rows, cfg))
        medians = exact_quantiles(rows, [CUSTOMER], "amount", {"median_amount": 0.5}, cfg)
        return stats.join(medians, CUSTOMER, "left").join(value_statistics(rows), CUSTOMER, "left")

    # one exchange of the rows' own columns (by_heat deals them) serves the statistics, the counts of values and their join
    stats = by_heat(df if shared else narrow(df), CUSTOMER, cfg, regular, skewed, keep_null=False, heat=heat, shared=shared)
    stats = stats.withColumns(vector_modes()).drop(*[f"_{c}" for c in VECTORS])
    days = F.greatest(F.col("active_days"), F.lit(1))
    total = F.col("total_txns")
    gap = F.datediff("last_date", "first_date") / F.greatest(total - 1, F.lit(1))
    return stats.withColumns(
        {
            "avg_daily_txns": total / days,
            "avg_weekly_txns": total / F.greatest(days / 7, F.lit(1.0)),
            "avg_monthly_txns": total / F.greatest(days / 30, F.lit(1.0)),
            "avg_txn_gap_days": F.when(total > 1, gap).otherwise(F.lit(0.0)),
        }
    )


def profile_flags(cfg: EngineConfig) -> dict[str, Column]:
    c = F.col
    return {
        "salary_account": (c("deposit_ratio") > 0.8) & (c("avg_monthly_txns") < 5),
        "business_account": (c("unique_beneficiaries") > 20) & (c("avg_monthly_txns") > 50),
        "frequent_transfer_user": (c("transfer_ratio") > 0.6) & (c("avg_weekly_txns") > 5),
        "cash_intensive_customer": c("cash_withdrawal_ratio") + c("deposit_ratio") > 0.5,
        "dormant_customer": c("avg_monthly_txns") < 0.5,
        "high_activity_customer": c("avg_daily_txns") > 3,
        "night_activity_customer": c("business_hours_ratio") < 0.2,
        "weekend_heavy_customer": c("weekend_ratio") > 0.4,
        "international_customer": c("unique_countries") > 1,
        "digital_first_customer": c("most_common_channel").isin(*cfg.digital_channels),
    }


def profile_confidence() -> Column:
    """History length, account age and consistency of amounts, weighted 0.5 / 0.3 / 0.2."""
    one = F.lit(1.0)
    history = F.least(F.col("total_txns") / 50.0, one)
    age = F.when(F.col("account_age_days") > 0, F.least(F.col("account_age_days") / 180.0, one)).otherwise(0.1)
    variation = F.col("std_amount") / F.col("avg_amount")
    steady = F.when(
        F.col("avg_amount") > 0, F.greatest(F.lit(0.0), F.least(one, one - variation / 3.0))
    ).otherwise(0.5)
    return F.round(F.least(one, F.greatest(F.lit(0.0), history * 0.5 + age * 0.3 + steady * 0.2)), 2)


def profile_summary() -> Column:
    """Plain sentences on rhythm, size, reach and cash use."""
    rhythm = F.when(F.col("dormant_customer"), F.lit("rarely")).otherwise(
        F.concat(F.col("avg_weekly_txns").cast("long"), F.lit(" times a week"))
    )
    period = F.when(F.col("night_activity_customer"), "night").otherwise("business hours")
    reach = F.when(F.col("international_customer"), "international").otherwise("domestic")
    return F.concat_ws(
        " ",
        F.concat(F.lit("Active "), rhythm, F.lit(", mostly in "), period, F.lit(".")),
        F.concat(F.lit("Average amount "), F.format_number("avg_amount", 2), F.lit(", "), reach, F.lit(" reach.")),
        F.when(F.col("cash_intensive_customer"), F.lit("Cash intensive.")),
    )


STATISTICS = (
    "avg_amount median_amount max_amount min_amount std_amount total_txns active_days first_date last_date "
    "avg_daily_txns avg_weekly_txns avg_monthly_txns avg_txn_gap_days preferred_hour most_active_weekday "
    "most_active_month business_hours_ratio weekend_ratio cash_withdrawal_ratio deposit_ratio transfer_ratio "
    "unique_beneficiaries unique_accounts unique_countries unique_devices unique_channels "
    "most_common_beneficiary most_common_channel most_common_txn_type"
).split()


def build_profiles(
    df: DataFrame, as_of: str | None = None, cfg: EngineConfig = EngineConfig(), heat: Heat | None = None, shared: bool = False
) -> DataFrame:
    """Profiles as structs; ``as_of`` keeps only earlier rows, so later rows can exceed the history.

    ``shared``: ``build_features`` reads the same rows with the same ``heat``; both then use one exchange.
    """
    rows = df if as_of is None else df.where(F.col("timestamp") < F.lit(as_of).cast("timestamp"))
    flat = profile_statistics(rows, cfg, heat, shared).withColumns(profile_flags(cfg))
    flags = list(profile_flags(cfg))
    return flat.select(
        CUSTOMER,
        F.struct(
            "account_age_days",
            "customer_age_group",
            "kyc_level",
            F.col("is_pep").alias("pep_status"),
            F.col("is_high_risk_country_history").alias("high_risk_country_history"),
            F.lit(0).alias("previous_sar_count"),
        ).alias("metadata"),
        F.struct(*STATISTICS).alias("statistics"),
        F.struct(*flags).alias("flags"),
        profile_confidence().alias("confidence_score"),
        profile_summary().alias("summary"),
    )


def get_profile(profiles: DataFrame, customer_id) -> DataFrame:
    return profiles.where(F.col(CUSTOMER) == F.lit(customer_id))


def type_ratio_table(df: DataFrame) -> DataFrame:
    """(customer, type, ratio) in long form: the pivot without a job to list the types."""
    counts = df.where(F.col("transaction_type").isNotNull()).groupBy(CUSTOMER, "transaction_type").agg(
        F.count(F.lit(1)).alias("txns")
    )
    totals = counts.groupBy(CUSTOMER).agg(F.sum("txns").alias("_total"))
    return counts.join(totals, CUSTOMER).select(
        CUSTOMER, "transaction_type", "txns", (F.col("txns") / F.col("_total")).alias("ratio")
    )
