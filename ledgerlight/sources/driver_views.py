"""Banking-shaped views over the TPC-H-like tables, used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def txn_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as card-like transactions: user, value, type as channel, ``props.k`` as device."""
    return as_transactions(table(spark, folder, "events"))


def as_transactions(events: DataFrame) -> DataFrame:
    """The same for events from anywhere, a stream for example."""
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("transaction_type"),
        F.col("event_type").alias("channel"),
        F.get_json_object("props", "$.k").alias("device_id"),
    )


def txn_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders joined to their customer and home nation."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        .join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
        .select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("timestamp"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderstatus").alias("transaction_type"),
            F.col("o_orderpriority").alias("channel"),
            F.col("n_name").alias("location_country"),
        )
    )


def txn_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as payments from the ordering customer to a supplier.

    Customers are joined to the orders, which are fewer than the lines, so lines are shuffled once.
    """
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select("o_orderkey", "o_custkey", "c_nationkey")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    home = nation.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("location_country"))
    away = nation.select(F.col("n_nationkey").alias("away_key"), F.col("n_name").alias("counterparty_country"))
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(supplier, F.col("l_suppkey") == supplier.s_suppkey, "left")
        .join(home, F.col("c_nationkey") == F.col("home_key"), "left")
        .join(away, F.col("s_nationkey") == F.col("away_key"), "left")
        .select(
            line_id().alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_suppkey").alias("counterparty_account_id"),
            "counterparty_country",
            "location_country",
            F.col("l_partkey").alias("merchant_id"),
            F.col("l_returnflag").alias("transaction_type"),
            F.col("l_linestatus").alias("channel"),
        )
    )


def line_id():
    """(order, line) repeats in the driver table, so the id uses every distinguishing column."""
    return F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("int"),
    )


def flow_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Money-flow edges: a customer pays a supplier, a returned line pays the customer back."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    payer = F.concat(F.lit("C"), F.col("o_custkey"))
    seller = F.concat(F.lit("S"), F.col("l_suppkey"))
    refund = F.col("l_returnflag") == "R"
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        line_id().alias("transaction_id"),
        F.when(refund, seller).otherwise(payer).alias("src"),
        F.when(refund, payer).otherwise(seller).alias("dst"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
    )


def nation_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Money-flow edges between the nations of customer and supplier: few accounts, each a hub of a twenty-fifth of all edges."""
    nations = table(spark, folder, "nation")
    customers = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("payer"))
    suppliers = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("seller"))
    # customers are joined to the orders, which are fewer than the lines
    orders = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "payer")
    named = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    refund = F.col("l_returnflag") == "R"
    return named.select(
        line_id().alias("transaction_id"), F.when(refund, F.col("seller")).otherwise(F.col("payer")).alias("src"),
        F.when(refund, F.col("payer")).otherwise(F.col("seller")).alias("dst"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
    )


def analyst_questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of the conversations table."""
    return (
        table(spark, folder, "conversations")
        .where(F.col("role") == "user")
        .select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "text")
    )
