"""Explicit schemas of the twelve banking tables, their keys and the checks that follow from them."""

from __future__ import annotations

# the column that keeps a line of a text file which does not fit the schema
BAD_RECORD = "_corrupt_record"

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TYPES = {"str": StringType(), "num": DoubleType(), "int": IntegerType(), "bool": BooleanType(), "ts": TimestampType()}

# Table -> column -> kind. Files are named <table>.csv.
TABLES: dict[str, dict[str, str]] = {
    "transaction": {
        "transaction_id": "str", "account_id": "str", "customer_id": "str", "timestamp": "ts",
        "transaction_type": "str", "channel": "str", "amount": "num", "currency": "str",
        "counterparty_account_id": "str", "counterparty_name": "str", "counterparty_country": "str",
        "merchant_id": "str", "device_id": "str", "location_id": "str", "balance_after": "num",
        "flag_label": "str", "aml_scenario_tag": "str",
    },
    "customer": {
        "customer_id": "str", "full_name": "str", "dob": "ts", "age": "int", "gender": "str",
        "nationality": "str", "occupation": "str", "profile_segment": "str", "annual_income": "num",
        "income_band": "str", "kyc_level": "str", "is_pep": "bool", "sanctions_hit": "bool",
        "beneficial_owner_id": "str", "onboarding_date": "ts", "branch_id": "str", "risk_score": "num",
    },
    "account": {
        "account_id": "str", "customer_id": "str", "account_type": "str", "branch_id": "str",
        "open_date": "ts", "currency": "str", "status": "str", "current_balance": "num",
        "avg_monthly_balance": "num", "linked_accounts": "str",
    },
    "device": {
        "device_id": "str", "customer_id": "str", "device_type": "str", "os": "str",
        "first_seen_date": "ts", "is_shared_device": "bool",
    },
    "beneficiary": {
        "beneficiary_id": "str", "customer_id": "str", "beneficiary_name": "str",
        "relationship_type": "str", "country_code": "str", "added_date": "ts",
    },
    "merchant": {
        "merchant_id": "str", "merchant_name": "str", "mcc_code": "str", "category": "str",
        "country_code": "str", "risk_level": "str",
    },
    "location": {
        "location_id": "str", "city": "str", "country_code": "str", "latitude": "num",
        "longitude": "num", "is_high_risk": "bool",
    },
    "branch": {
        "branch_id": "str", "branch_name": "str", "country_code": "str", "city": "str",
        "is_high_risk_branch": "bool",
    },
    "country_risk": {"country_code": "str", "country_name": "str", "fatf_status": "str", "risk_score": "num"},
    "customer_relationship": {
        "relationship_id": "str", "customer_id_1": "str", "customer_id_2": "str",
        "relationship_type": "str", "is_symmetric": "bool",
    },
    "fraud_ring": {
        "fraud_ring_id": "str", "ring_name": "str", "ring_type": "str", "formation_date": "ts",
        "num_members": "int",
    },
    "customer_fraud_ring_membership": {
        "membership_id": "str", "fraud_ring_id": "str", "customer_id": "str", "role": "str",
    },
}

# Keys, mandatory columns, references and ranges of the twelve tables.
PRIMARY_KEYS = {
    "transaction": "transaction_id",
    "customer": "customer_id",
    "account": "account_id",
    "device": "device_id",
    "beneficiary": "beneficiary_id",
    "merchant": "merchant_id",
    "location": "location_id",
    "branch": "branch_id",
    "country_risk": "country_code",
    "customer_relationship": "relationship_id",
    "fraud_ring": "fraud_ring_id",
    "customer_fraud_ring_membership": "membership_id",
}

NOT_NULL = {
    "transaction": ("transaction_id", "account_id", "customer_id", "amount"),
    "customer": ("customer_id", "full_name", "dob"),
    "account": ("account_id", "customer_id", "branch_id"),
}

# child table, child column, parent table, parent column, nulls allowed
FOREIGN_KEYS = (
    ("transaction", "account_id", "account", "account_id", False),
    ("transaction", "customer_id", "customer", "customer_id", False),
    ("transaction", "merchant_id", "merchant", "merchant_id", True),
    ("transaction", "device_id", "device", "device_id", True),
    ("transaction", "location_id", "location", "location_id", True),
    ("transaction", "counterparty_country", "country_risk", "country_code", True),
    ("customer", "branch_id", "branch", "branch_id", False),
    ("customer", "beneficial_owner_id", "customer", "customer_id", True),
    ("account", "branch_id", "branch", "branch_id", False),
    ("device", "customer_id", "customer", "customer_id", False),
    ("beneficiary", "customer_id", "customer", "customer_id", False),
    ("beneficiary", "country_code", "country_risk", "country_code", True),
    ("branch", "country_code", "country_risk", "country_code", True),
    ("merchant", "country_code", "country_risk", "country_code", True),
    ("location", "country_code", "country_risk", "country_code", True),
    ("customer_relationship", "customer_id_1", "customer", "customer_id", False),
    ("customer_relationship", "customer_id_2", "customer", "customer_id", False),
    ("customer_fraud_ring_membership", "fraud_ring_id", "fraud_ring", "fraud_ring_id", False),
    ("customer_fraud_ring_membership", "customer_id", "customer", "customer_id", False),
)

RANGES = (("transaction", "amount", 0.01, None), ("customer", "age", 0, None))
DATE_COLUMNS = {t: tuple(c for c, k in cols.items() if k == "ts") for t, cols in TABLES.items()}


def schema(table: str, raw: bool = False) -> StructType:
    """Typed schema, or all strings for messy files that the cleaning operators will type."""
    fields = [StructField(c, StringType() if raw else TYPES[k], True) for c, k in TABLES[table].items()]
    return StructType(fields)
