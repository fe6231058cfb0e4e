"""Transaction features per customer: amount, velocity, deviation, counterparty, device, channel, place.

Ordinary customers: every window is partitioned by customer, so one exchange serves them all.
Hot customers: see :mod:`ledgerlight.operators.ordered`.

Windows are left-open and count all rows at an equal timestamp. Columns a table does not have give
the constants an absent signal stands for. Rows without a customer have no features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.config import HIGH_RISK_COUNTRIES, EngineConfig
from ledgerlight.functions.timeparts import DAY, HOUR, micros
from ledgerlight.operators.ordered import (
    Heat,
    HotKeys,
    Rolling,
    by_heat,
    distinct_steps,
    distinct_steps_sliced,
    exact_quantiles,
    occurrence_number,
    occurrence_number_sliced,
    previous_values,
    rolling_sliced,
    running_sums,
    with_slices,
)

EPSILON = 1e-5
CUSTOMER = "customer_id"
ORDER = ["_us", "transaction_id"]
# amounts of hot customers from here on (and what is no number) are kept apart from the exact sums
BIG = 1e12
EXACT = "decimal(38,6)"

# profile field -> type, as attached to transactions under the prefix ``profile_``
PROFILE_FIELDS = {
    "avg_amount": "double",
    "median_amount": "double",
    "std_amount": "double",
    "max_amount": "double",
    "min_amount": "double",
    "preferred_hour": "int",
    "most_active_weekday": "int",
    "most_active_month": "int",
    "avg_daily_txns": "double",
    "avg_monthly_txns": "double",
    "most_common_channel": "string",
    "business_hours_ratio": "double",
    "weekend_ratio": "double",
    "cash_withdrawal_ratio": "double",
    "deposit_ratio": "double",
    "transfer_ratio": "double",
    "unique_beneficiaries": "bigint",
    "dormant_customer": "boolean",
    "cash_intensive_customer": "boolean",
}


def has(df: DataFrame, column: str) -> bool:
    return column in df.columns


# --- profile columns -----------------------------------------------------------------------------


def with_profile(df: DataFrame, profiles: DataFrame | None, hot: HotKeys | None = None) -> DataFrame:
    """Left join the profile fields; without profiles the columns are null."""
    if profiles is None:
        return df.withColumns(
            {f"profile_{n}": F.lit(None).cast(t) for n, t in PROFILE_FIELDS.items()}
            | {"has_profile": F.lit(False)}
        )
    nested = {"dormant_customer": "flags", "cash_intensive_customer": "flags"}
    picked = profiles.select(
        CUSTOMER,
        *[F.col(f"{nested.get(n, 'statistics')}.{n}").cast(t).alias(f"profile_{n}") for n, t in PROFILE_FIELDS.items()],
        F.lit(True).alias("_found"),
    )
    if hot is not None:
        picked = picked.join(hot.hinted(), CUSTOMER, "left_semi")
        picked = F.broadcast(picked) if hot.small else picked
    joined = df.join(picked, CUSTOMER, "left")
    return joined.withColumn("has_profile", F.coalesce("_found", F.lit(False))).drop("_found")


# --- amount ----------------------------------------------------------------------------------------


def amount_scale(df: DataFrame) -> DataFrame:
    """Customer statistics and percentile rank by windows."""
    whole = Window.partitionBy(CUSTOMER)
    ranked = whole.orderBy(F.col("amount").asc_nulls_last())
    # average rank of a tie = (first rank + last rank) / 2, and the last rank is the peer-inclusive count
    average_rank = (F.rank().over(ranked) + F.count(F.lit(1)).over(ranked)) / 2
    return df.withColumns(
        {
            "_avg": F.avg("amount").over(whole),
            "_median": F.expr("percentile(amount, 0.5) over (partition by customer_id)"),
            "_std": F.coalesce(F.stddev_samp("amount").over(whole), F.lit(0.0)),
            "_max": F.max("amount").over(whole),
            "_min": F.min("amount").over(whole),
            "amount_percentile": F.when(
                F.col("amount").isNotNull(), average_rank / F.count("amount").over(whole)
            ),
        }
    )


def amount_scale_sliced(df: DataFrame, base: DataFrame, hot: HotKeys, cfg: EngineConfig) -> DataFrame:
    """The same columns for hot customers from aggregates and a running count over amounts."""
    stats = base.groupBy(CUSTOMER).agg(
        F.avg("amount").alias("_avg"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("_std"),
        F.max("amount").alias("_max"),
        F.min("amount").alias("_min"),
        F.count("amount").alias("_known"),
    )
    medians = exact_quantiles(base, [CUSTOMER], "amount", {"_median": 0.5}, cfg)
    stats = stats.join(medians, CUSTOMER, "left")
    counts = base.where(F.col("amount").isNotNull()).groupBy(CUSTOMER, "amount").agg(F.count(F.lit(1)).alias("_same"))
    ranks = running_sums(
        with_slices(counts, [CUSTOMER], "amount", cfg), [CUSTOMER], ["amount"], {"_upto": F.col("_same")}
    ).select(CUSTOMER, "amount", (F.col("_upto") - (F.col("_same") - 1) / 2).alias("_rank"))
    return (
        df.join(F.broadcast(stats) if hot.small else stats, CUSTOMER, "left")
        .join(ranks, [CUSTOMER, "amount"], "left")
        .withColumn("amount_percentile", F.col("_rank") / F.col("_known"))
        .drop("_rank", "_known")
    )


def finish_amount(df: DataFrame) -> DataFrame:
    """Differences, ratio, z-score and the large flag; profile values win over data values."""

    def pick(field: str, own: str) -> Column:
        return F.coalesce(F.col(f"profile_{field}"), F.col(own)).cast("double")

    scaled = df.withColumns(
        {
            "transaction_amount": F.col("amount").cast("double"),
            "customer_average_amount": pick("avg_amount", "_avg"),
            "customer_median_amount": pick("median_amount", "_median"),
            "customer_std_amount": pick("std_amount", "_std"),
            "historical_max_amount": pick("max_amount", "_max"),
            "historical_min_amount": pick("min_amount", "_min"),
        }
    ).drop("_avg", "_median", "_std", "_max", "_min")
    amount, mean = F.col("transaction_amount"), F.col("customer_average_amount")
    scored = scaled.withColumns(
        {
            "amount_difference": amount - mean,
            "amount_ratio_to_average": amount / (mean + EPSILON),
            "amount_z_score": (amount - mean) / (F.col("customer_std_amount") + EPSILON),
            "historical_average_amount": mean,
        }
    )
    return scored.withColumn("large_transaction_flag", (F.col("amount_z_score") > 3.0) | (amount > 3.0 * mean))


# --- velocity ----------------------------------------------------------------------------------------


def velocity(df: DataFrame) -> DataFrame:
    """Gap to the previous transaction and trailing counts, sums, mean and deviation."""
    ordered = Window.partitionBy(CUSTOMER).orderBy(*ORDER)

    def last(length: int):
        return Window.partitionBy(CUSTOMER).orderBy("_us").rangeBetween(-length + 1, 0)

    gap = (F.col("_us") - F.lag("_us").over(ordered)) / F.lit(float(HOUR))
    day, week = last(DAY), last(7 * DAY)
    timed = df.withColumn("time_since_previous_transaction", F.coalesce(gap, F.lit(0.0)))
    return timed.withColumns(
        {
            "transactions_last_hour": F.count("amount").over(last(HOUR)),
            "transactions_last_day": F.count("amount").over(day),
            "amount_last_day": F.sum("amount").over(day),
            "transactions_last_week": F.count("amount").over(week),
            "amount_last_week": F.sum("amount").over(week),
            "rolling_transaction_count": F.count("amount").over(day),
            "rolling_average_amount": F.avg("amount").over(day),
            "rolling_std_amount": F.coalesce(F.stddev_samp("amount").over(day), F.lit(0.0)),
            "average_gap_between_transactions": F.avg("time_since_previous_transaction").over(week),
        }
    )


def velocity_sliced(df: DataFrame, base: DataFrame, cfg: EngineConfig, small: bool) -> DataFrame:
    """Trailing windows of hot customers as running sums of exact decimals; see ``parts`` for what does not fit them."""
    keyed = [CUSTOMER]

    def with_gap(rows: DataFrame) -> DataFrame:
        lagged = previous_values(rows, keyed, ORDER, ["_us"], "_prev", base)
        return lagged.withColumn("_gap", F.coalesce(F.col("_us") - F.col("_prev._us"), F.lit(0))).drop("_prev")

    amount = F.col("amount").cast("double")
    infinite = float("inf")
    number = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != infinite)
    big = number & (F.abs(amount) >= BIG)
    # distances from a middle amount of the customer keep the squares small; per hot customer one sketch
    centres = base.groupBy(CUSTOMER).agg(F.coalesce(F.percentile_approx(F.when(number & ~big, amount), 0.5, 100), F.lit(0.0)).alias("_centre"))
    centres = F.broadcast(centres) if small else centres
    off = amount - F.col("_centre")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    def parts(span: str, length: int) -> dict[str, Rolling]:
        """Exact sums of ordinary amounts; counts tell whether anything else lies in the window."""
        return {
            f"t_n_{span}": Rolling(amount.isNotNull().cast("int"), length),
            f"t_s_{span}": Rolling(F.when(number & ~big, off), length, EXACT),
            f"t_q_{span}": Rolling(F.when(number & ~big, off * off), length, EXACT),
            f"t_big_{span}": Rolling(flag(big), length),
            f"t_bs_{span}": Rolling(F.when(big, off), length, "double"),
            f"t_bq_{span}": Rolling(F.when(big, off * off), length, "double"),
            f"t_nan_{span}": Rolling(flag(F.isnan(amount)), length),
            f"t_up_{span}": Rolling(flag(amount == infinite), length),
            f"t_down_{span}": Rolling(flag(amount == -infinite), length),
        }

    totals = rolling_sliced(
        with_gap(base).join(centres, CUSTOMER),
        CUSTOMER,
        {
            "t_n_hour": Rolling(amount.isNotNull().cast("int"), HOUR), **parts("day", DAY), **parts("week", 7 * DAY),
            "t_rows_week": Rolling(F.lit(1), 7 * DAY), "t_g_week": Rolling(F.col("_gap"), 7 * DAY),
        },
        cfg,
    ).join(centres, CUSTOMER)

    def summed(span: str) -> tuple[Column, Column, Column, Column]:
        """Count, sum, sum of distances and of their squares; the sum of a window may be NaN or infinite."""
        c = lambda name: F.col(f"t_{name}_{span}")
        s = c("s").cast("double") + F.when(c("big") > 0, c("bs")).otherwise(0.0)
        q = c("q").cast("double") + F.when(c("big") > 0, c("bq")).otherwise(0.0)
        plain = s + F.col("_centre") * (c("n") - c("nan") - c("up") - c("down"))
        total = (
            F.when((c("nan") > 0) | ((c("up") > 0) & (c("down") > 0)), float("nan"))
            .when(c("up") > 0, infinite).when(c("down") > 0, -infinite).otherwise(plain)
        )
        return c("n"), F.when(c("n") > 0, total), s, q

    n, day_sum, s, q = summed("day")
    week_n, week_sum, _, _ = summed("week")
    strange = F.col("t_nan_day") + F.col("t_up_day") + F.col("t_down_day") > 0
    variance = (q - s * s / n) / (n - 1)
    spread = (
        F.when(n <= 1, 0.0).when(strange, float("nan"))
        .when(variance * (n - 1) > q * 1e-13, F.sqrt(variance)).otherwise(0.0)
    )
    looked_up = totals.select(
        CUSTOMER,
        "_us",
        F.col("t_n_hour").alias("transactions_last_hour"),
        n.alias("transactions_last_day"),
        day_sum.alias("amount_last_day"),
        week_n.alias("transactions_last_week"),
        week_sum.alias("amount_last_week"),
        n.alias("rolling_transaction_count"),
        F.when(n > 0, day_sum / n).alias("rolling_average_amount"),
        spread.alias("rolling_std_amount"),
        (F.col("t_g_week") / F.col("t_rows_week") / F.lit(float(HOUR))).alias("average_gap_between_transactions"),
    )
    return (
        with_gap(df)
        .withColumn("time_since_previous_transaction", F.col("_gap") / F.lit(float(HOUR)))
        .drop("_gap")
        .join(looked_up, [CUSTOMER, "_us"], "left")
    )


# --- pairs of customer and counterparty / device / channel / country ---------------------------------

PAIRS = {
    "counterparty_account_id": ("new_beneficiary", "beneficiary_frequency"),
    "device_id": ("new_device", "device_frequency"),
    "channel": ("new_channel", "channel_frequency"),
    "counterparty_country": ("new_country", "country_frequency"),
}
SWITCHES = {"device_id": "device_switch_flag", "counterparty_country": "geographic_change"}


def first_seen(df: DataFrame) -> DataFrame:
    """Running occurrence numbers and changes against the previous transaction."""
    for column, (_, frequency) in PAIRS.items():
        if has(df, column):
            df = occurrence_number(df, [CUSTOMER, column], ORDER, frequency)
    ordered = Window.partitionBy(CUSTOMER).orderBy(*ORDER)
    for column, flag in SWITCHES.items():
        if has(df, column):
            before = F.lag(column).over(ordered)
            df = df.withColumn(flag, F.coalesce(F.col(column) != before, F.lit(False)))
    return df


def first_seen_sliced(df: DataFrame, base: DataFrame) -> DataFrame:
    for column, (_, frequency) in PAIRS.items():
        if has(df, column):
            df = occurrence_number_sliced(df, [CUSTOMER, column], ORDER, frequency, base)
    watched = [c for c in SWITCHES if has(df, c)]
    if watched:
        df = previous_values(df, [CUSTOMER], ORDER, watched, "_prev", base)
        for column in watched:
            changed = F.coalesce(F.col(column) != F.col("_prev")[column], F.lit(False))
            df = df.withColumn(SWITCHES[column], changed)
        df = df.drop("_prev")
    return df


def counterparty_totals(df: DataFrame) -> DataFrame:
    pair = Window.partitionBy(CUSTOMER, "counterparty_account_id")
    known = F.col("counterparty_account_id").isNotNull()
    return df.withColumns(
        {
            "beneficiary_transaction_count": F.when(known, F.count(F.lit(1)).over(pair)),
            "beneficiary_amount_average": F.when(known, F.avg("amount").over(pair)),
            "beneficiary_amount_std": F.when(known, F.coalesce(F.stddev_samp("amount").over(pair), F.lit(0.0))),
        }
    )


def counterparty_totals_sliced(df: DataFrame, base: DataFrame) -> DataFrame:
    pair = [CUSTOMER, "counterparty_account_id"]
    totals = (
        base.where(F.col(pair[1]).isNotNull())
        .groupBy(*pair)
        .agg(
            F.count(F.lit(1)).alias("beneficiary_transaction_count"),
            F.avg("amount").alias("beneficiary_amount_average"),
            F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("beneficiary_amount_std"),
        )
    )
    return df.join(totals, pair, "left")


def modal_channel(df: DataFrame) -> DataFrame:
    """Most frequent channel of the customer's rows, the smallest on ties."""
    modes = "mode() within group (order by channel) over (partition by customer_id)"
    return df.withColumn("_mode_channel", F.expr(modes))


def modal_value(df: DataFrame, column: str, name: str) -> DataFrame:
    """Mode per customer by counting first: safe for hot customers and unbounded vocabularies."""
    counts = df.where(F.col(column).isNotNull()).groupBy(CUSTOMER, column).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.groupBy(CUSTOMER).agg(F.max("_n").alias("_n"))
    return counts.join(most, [CUSTOMER, "_n"]).groupBy(CUSTOMER).agg(F.min(column).alias(name))


# --- narrow finishing steps --------------------------------------------------------------------------


def finish_behaviour(df: DataFrame) -> DataFrame:
    """Deviation from the profile's habits and the weighted deviation score."""
    ts = F.col("timestamp")
    hour = F.col("hour_of_day") if has(df, "hour_of_day") else F.hour(ts)
    weekday = F.col("day_of_week") if has(df, "day_of_week") else F.weekday(ts)
    month = F.col("transaction_month") if has(df, "transaction_month") else F.month(ts)
    business = F.col("is_business_hours") if has(df, "is_business_hours") else hour.between(9, 17)

    def differs(now: Column, habit: str) -> Column:
        return F.coalesce(now != F.col(f"profile_{habit}"), F.lit(False))

    def unit(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(5.0)) / 5.0

    daily = F.coalesce("profile_avg_daily_txns", F.lit(1.0)) + EPSILON
    flagged = df.withColumns(
        {
            "outside_business_hours": F.coalesce(~business, F.lit(False)),
            "outside_preferred_hour": differs(hour, "preferred_hour"),
            "unusual_weekday": differs(weekday, "most_active_weekday"),
            "unusual_month": differs(month, "most_active_month"),
            "amount_deviation_score": unit(F.abs("amount_z_score")),
            "frequency_deviation_score": unit(F.col("transactions_last_day") / daily),
        }
    )
    score = (
        0.4 * F.col("amount_deviation_score")
        + 0.3 * F.col("frequency_deviation_score")
        + 0.1 * F.col("outside_business_hours").cast("double")
        + 0.1 * F.col("outside_preferred_hour").cast("double")
        + 0.1 * F.col("unusual_weekday").cast("double")
    )
    return flagged.withColumn("behaviour_deviation_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def finish_pairs(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """First-time flags, home-country comparison, high-risk country; constants where a signal is absent."""
    false = F.lit(False)
    for column, (new, frequency) in PAIRS.items():
        if has(df, column):
            df = df.withColumn(new, F.coalesce(F.col(frequency) == 1, false))
        else:
            df = df.withColumns({new: false, frequency: F.lit(1).cast("long")})
    for column, flag in SWITCHES.items():
        if not has(df, column):
            df = df.withColumn(flag, false)
    if not has(df, "counterparty_account_id"):
        df = df.withColumns(
            {
                "beneficiary_transaction_count": F.lit(1).cast("long"),
                "beneficiary_amount_average": F.col("amount").cast("double"),
                "beneficiary_amount_std": F.lit(0.0),
            }
        )
    df = df.withColumn(
        "beneficiary_is_high_frequency", F.coalesce(F.col("beneficiary_transaction_count") > 10, false)
    )
    if not has(df, "device_id"):
        df = df.withColumn("unique_devices_last_30_days", F.lit(1).cast("long"))
    if has(df, "channel"):
        df = df.withColumn("preferred_channel", F.coalesce("profile_most_common_channel", "_mode_channel"))
        df = df.withColumn(
            "outside_preferred_channel", F.coalesce(F.col("channel") != F.col("preferred_channel"), false)
        ).drop("_mode_channel")
    else:
        df = df.withColumns({"preferred_channel": F.lit("UNKNOWN"), "outside_preferred_channel": false})
    if has(df, "counterparty_country"):
        country = F.col("counterparty_country")
        home = F.col("location_country") if has(df, "location_country") else F.lit(cfg.home_country)
        risky = (
            F.upper("fatf_status") != "NORMAL" if has(df, "fatf_status") else country.isin(*HIGH_RISK_COUNTRIES)
        )
        df = df.withColumns(
            {
                "cross_border_transaction": F.coalesce(country != home, false),
                "high_risk_country_flag": F.coalesce(risky, false),
            }
        )
    else:
        df = df.withColumns({"cross_border_transaction": false, "high_risk_country_flag": false})
    return df.withColumn("distance_from_previous_country", F.col("geographic_change").cast("double") * 500.0)


def finish_history(df: DataFrame) -> DataFrame:
    """Customer attributes with their defaults."""
    defaults = {
        "account_age_days": F.lit(0),
        "customer_age_group": F.lit("Unknown"),
        "kyc_level": F.lit("VERIFIED"),
        "previous_sar_count": F.lit(0),
    }
    for column, default in defaults.items():
        df = df.withColumn(column, F.coalesce(F.col(column), default) if has(df, column) else default)
    pep = F.coalesce(F.col("is_pep").cast("boolean"), F.lit(False)) if has(df, "is_pep") else F.lit(False)
    return df.withColumn("pep_flag", pep)


# --- public operators ----------------------------------------------------------------------------------


def amount_features(df: DataFrame, profiles: DataFrame | None = None, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    rows = by_heat(
        df,
        CUSTOMER,
        cfg,
        lambda cold: amount_scale(with_profile(cold, profiles)),
        lambda hot, keys: amount_scale_sliced(with_profile(hot, profiles, keys), hot, keys, cfg),
    )
    return finish_amount(rows)


def velocity_features(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    rows = df.withColumn("_us", micros("timestamp"))

    def skewed(hot: DataFrame, keys: HotKeys) -> DataFrame:
        base = time_slices(hot, keys, cfg)
        return velocity_sliced(base, base, cfg, keys.small).drop("_slice")

    return by_heat(rows, CUSTOMER, cfg, velocity, skewed).drop("_us")


def pair_features(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Counterparty, device, channel and country features without profiles."""
    rows = with_profile(df.withColumn("_us", micros("timestamp")), None)
    shaped = by_heat(
        rows,
        CUSTOMER,
        cfg,
        _pairs_regular,
        lambda hot, keys: _pairs_sliced(hot, None, keys, cfg),
    )
    return finish_pairs(shaped, cfg).drop("_us", "has_profile", *[f"profile_{n}" for n in PROFILE_FIELDS])


def _pairs_regular(df: DataFrame) -> DataFrame:
    rows = first_seen(df)
    if has(df, "counterparty_account_id"):
        rows = counterparty_totals(rows)
    if has(df, "channel"):
        rows = modal_channel(rows)
    if has(df, "device_id"):
        rows = distinct_steps(rows, CUSTOMER, "device_id", 30 * DAY, "unique_devices_last_30_days")
    return rows


def time_slices(hot: DataFrame, keys: HotKeys, cfg: EngineConfig) -> DataFrame:
    """Rows of hot customers cut into time slices and saved once for all later steps."""
    return with_slices(hot, [CUSTOMER], "_us", cfg)


def _pairs_sliced(df: DataFrame, base: DataFrame | None, keys: HotKeys, cfg: EngineConfig) -> DataFrame:
    if base is None:
        df = base = time_slices(df, keys, cfg)
    rows = first_seen_sliced(df, base)
    if has(df, "counterparty_account_id"):
        rows = counterparty_totals_sliced(rows, base)
    if has(df, "channel"):
        modes = modal_value(base, "channel", "_mode_channel")
        rows = rows.join(F.broadcast(modes) if keys.small else modes, CUSTOMER, "left")
    if has(df, "device_id"):
        name = "unique_devices_last_30_days"
        rows = distinct_steps_sliced(rows, CUSTOMER, "device_id", 30 * DAY, name, cfg, base)
    return rows.drop("_slice")


def build_features(
    df: DataFrame, profiles: DataFrame | None = None, cfg: EngineConfig = EngineConfig(), heat: Heat | None = None, shared: bool = False
) -> DataFrame:
    """All feature columns on the transactions; one exchange by customer for ordinary customers.

    ``shared``: ``build_profiles`` reads the same rows with the same ``heat``; both then use that exchange.
    """

    def timed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_us", micros("timestamp"))

    def regular(cold: DataFrame) -> DataFrame:
        return _pairs_regular(velocity(amount_scale(with_profile(timed(cold), profiles))))

    def skewed(hot: DataFrame, keys: HotKeys) -> DataFrame:
        base = time_slices(timed(hot), keys, cfg)
        scaled = amount_scale_sliced(with_profile(base, profiles, keys), base, keys, cfg)
        return _pairs_sliced(velocity_sliced(scaled, base, cfg, keys.small), base, keys, cfg)

    shaped = by_heat(df, CUSTOMER, cfg, regular, skewed, heat=heat, shared=shared)
    return finish_history(finish_pairs(finish_behaviour(finish_amount(shaped)), cfg)).drop("_us")
