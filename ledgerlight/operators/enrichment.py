"""Enrichment joins and simple features of the flat transaction frame.

All joins are left joins to unique keys. No hints: the planner broadcasts a side whose size it knows
to be small, and adaptive execution splits skewed partitions of the transaction side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.config import FATF_WEIGHTS, KYC_ORDINAL, KYC_WEIGHTS, SEGMENT_EXPECTED_AVERAGE, EngineConfig
from ledgerlight.functions.timeparts import with_time_parts


def lookup(values: dict, key: Column, default=None) -> Column:
    """Small constant table as an expression."""
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def age_band(age: Column) -> Column:
    """(0,18], (18,30], (30,50], (50,70], (70,120]; everything else is Unknown."""
    return (
        F.when((age > 0) & (age <= 18), "Under 18")
        .when((age > 18) & (age <= 30), "18-30")
        .when((age > 30) & (age <= 50), "31-50")
        .when((age > 50) & (age <= 70), "51-70")
        .when((age > 70) & (age <= 120), "Over 70")
        .otherwise("Unknown")
    )


def account_age_days(opened: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    days = F.datediff(F.lit(cfg.snapshot_date).cast("date"), opened.cast("date"))
    return F.when(opened.isNotNull(), F.greatest(days, F.lit(0)))


def enrich(
    transactions: DataFrame, customers: DataFrame, accounts: DataFrame, country_risk: DataFrame | None = None,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """Transactions with account, customer and country columns."""
    rows = transactions if "is_business_hours" in transactions.columns else with_time_parts(transactions)
    account = accounts.select(
        "account_id", F.col("status").alias("account_status"),
        account_age_days(F.col("open_date"), cfg).alias("account_age_days"), "avg_monthly_balance",
    )
    customer = customers.select(
        "customer_id", "profile_segment", age_band(F.col("age")).alias("customer_age_group"), "annual_income",
        "kyc_level", "is_pep", "sanctions_hit", F.col("risk_score").alias("customer_risk_score"),
    )
    rows = rows.join(account, "account_id", "left").join(customer, "customer_id", "left")
    if country_risk is not None and "counterparty_country" in rows.columns:
        country = country_risk.select(
            F.col("country_code").alias("_country"), "fatf_status", F.col("risk_score").alias("country_risk_score")
        )
        rows = rows.join(country, F.col("counterparty_country") == F.col("_country"), "left").drop("_country")
    false = F.lit(False)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("boolean"), false) for c in ("is_pep", "sanctions_hit")})


def optional_enrichment(
    enriched: DataFrame, merchants: DataFrame | None = None, locations: DataFrame | None = None,
    branches: DataFrame | None = None, memberships: DataFrame | None = None, customers: DataFrame | None = None,
    devices: DataFrame | None = None, cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """The declared extra columns that follow from one join or expression each."""
    rows, false = enriched, F.lit(False)
    if merchants is not None:
        side = merchants.select("merchant_id", F.col("risk_level").alias("merchant_risk_level"))
        rows = rows.join(side, "merchant_id", "left")
    if locations is not None:
        side = locations.select("location_id", F.col("is_high_risk").alias("is_high_risk_location"),
                                F.col("country_code").alias("location_country"))
        rows = rows.join(side, "location_id", "left")
        rows = rows.withColumn("is_high_risk_location", F.coalesce("is_high_risk_location", false))
    if customers is not None:
        side = customers.select("customer_id", "branch_id", "onboarding_date")
        rows = rows.join(side, "customer_id", "left")
        rows = rows.withColumn("days_since_onboarding", F.datediff("timestamp", "onboarding_date"))
        if branches is not None:
            rows = rows.join(branches.select("branch_id", F.col("is_high_risk_branch").alias("is_high_risk_branch")), "branch_id", "left")
            rows = rows.withColumn("is_high_risk_branch", F.coalesce("is_high_risk_branch", false))
    if memberships is not None:
        side = memberships.groupBy("customer_id").agg(F.min("role").alias("fraud_ring_role"))
        rows = rows.join(side, "customer_id", "left").withColumn("in_fraud_ring", F.col("fraud_ring_role").isNotNull())
    if devices is not None:
        side = devices.select("device_id", F.col("is_shared_device").alias("shared_device_flag"))
        rows = rows.join(side, "device_id", "left").withColumn("shared_device_flag", F.coalesce("shared_device_flag", false))

    def ratio(column: str) -> Column:
        return F.col("amount") / F.nullif(F.col(column), F.lit(0.0))

    return rows.withColumns(
        {
            "amount_to_income_ratio": ratio("annual_income"),
            "amount_to_avg_balance_ratio": ratio("avg_monthly_balance"),
            "is_dormant_account": F.coalesce(F.col("account_status") == "Dormant", false),
            "is_high_risk_counterparty": F.coalesce(F.col("fatf_status").isin("Grey", "Black"), false)
            if "fatf_status" in rows.columns else false,
            "is_international": F.coalesce(F.col("counterparty_country") != F.lit(cfg.home_country), false)
            if "counterparty_country" in rows.columns else false,
            "segment_expected_average": lookup(SEGMENT_EXPECTED_AVERAGE, F.col("profile_segment")),
            "kyc_risk_weight": lookup(KYC_WEIGHTS, F.col("kyc_level")),
            "fatf_risk_weight": lookup(FATF_WEIGHTS, F.col("fatf_status")) if "fatf_status" in rows.columns else F.lit(None).cast("double"),
        }
    )


def network_columns(
    rows: DataFrame, accounts: DataFrame, relationships: DataFrame, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Trailing counts and relations of a transaction's customer.

    ``txn_count_1h``, ``txn_count_24h`` and ``txn_amount_24h`` up to and with the row; ``relationship_count``, the customer's
    distinct partners; ``counterparty_relationship_exists``, whether the owner of the counterparty's account is one of them,
    in either direction. Accounts and pairs of customers are unique, so no row is multiplied.
    """
    from ledgerlight.operators.features import velocity_features

    trailing = {"transactions_last_hour": "txn_count_1h", "transactions_last_day": "txn_count_24h", "amount_last_day": "txn_amount_24h"}
    timed = velocity_features(rows, cfg)
    out = timed.select(*rows.columns, *[F.col(c).alias(n) for c, n in trailing.items()])
    owners = accounts.groupBy(F.col("account_id").alias("counterparty_account_id")).agg(F.min("customer_id").alias("_partner"))
    a, b = F.col("customer_id_1"), F.col("customer_id_2")
    ends = F.array(F.struct(a.alias("customer_id"), b.alias("_partner")), F.struct(b.alias("customer_id"), a.alias("_partner")))
    related = relationships.select(F.inline(ends)).where("customer_id IS NOT NULL AND _partner IS NOT NULL").distinct()
    out = out.join(owners, "counterparty_account_id", "left").join(related.withColumn("_known", F.lit(True)), ["customer_id", "_partner"], "left")
    degree = relationship_degree(relationships).withColumnRenamed("relationship_degree", "relationship_count")
    out = out.join(degree, "customer_id", "left")
    return out.withColumns(
        {"relationship_count": F.coalesce("relationship_count", F.lit(0)), "counterparty_relationship_exists": F.coalesce("_known", F.lit(False))}
    ).drop("_partner", "_known")


def basic_features(df: DataFrame) -> DataFrame:
    """Weekend and round-amount flags, PEP and sanctions as 0/1, KYC as an ordinal."""
    false = F.lit(False)
    timed = df if "is_weekend" in df.columns else with_time_parts(df)
    out = timed.withColumns(
        {
            "is_weekend_int": F.col("is_weekend").cast("int"),
            "is_round_amount": F.coalesce(F.col("amount") % 1000 == 0, false).cast("int"),
        }
    )
    for column, name in (("is_pep", "is_pep_int"), ("sanctions_hit", "sanctions_int")):
        if column in df.columns:
            out = out.withColumn(name, F.coalesce(F.col(column).cast("boolean"), false).cast("int"))
    if "kyc_level" in df.columns:
        out = out.withColumn("kyc_ordinal", lookup(KYC_ORDINAL, F.col("kyc_level"), 0))
    return out


def relationship_degree(relationships: DataFrame, left: str = "customer_id_1", right: str = "customer_id_2") -> DataFrame:
    """Distinct undirected neighbours per customer; a relation with oneself counts twice.

    Each relation becomes its two directions in place, so the table is read once.
    """
    a, b = F.col(left), F.col(right)
    ends = F.array(F.struct(a.alias("customer_id"), b.alias("other")), F.struct(b.alias("customer_id"), a.alias("other")))
    sides = relationships.where(a.isNotNull() & b.isNotNull()).select(F.inline(ends)).distinct()
    weight = F.when(F.col("customer_id") == F.col("other"), 2).otherwise(1)
    return sides.groupBy("customer_id").agg(F.sum(weight).alias("relationship_degree"))


def with_relationship_degree(customers: DataFrame, relationships: DataFrame) -> DataFrame:
    degree = relationship_degree(relationships)
    return customers.join(degree, "customer_id", "left").withColumn(
        "relationship_degree", F.coalesce("relationship_degree", F.lit(0))
    )
