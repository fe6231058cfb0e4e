"""How work is dealt: rows a task, detectors run once, questions over all tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlight.config import EngineConfig
from ledgerlight.operators import detectors, features, ordered, profiles, reports, triage
from ledgerlight.plans import registered
from ledgerlight.sources import driver_views as views
from tests.helpers import at, same_rows, vectors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ordinary_rows_are_dealt_to_as_many_tasks_as_they_need(spark):
    rows = spark.range(400).select((F.col("id") % 100).alias("customer_id"), F.col("id").alias("transaction_id"))
    out = ordered.by_heat(rows, "customer_id", EngineConfig(task_rows=10), lambda cold: cold, lambda hot, keys: hot)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count()
    assert out.rdd.getNumPartitions() == 40
    assert out.count() == 400 and sizes.agg(F.max("count")).first()[0] <= 40
    assert ordered.find_heat(rows, "customer_id", EngineConfig()) == (None, False, 400)


def test_heat_tells_hot_ordinary_and_missing_keys(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)] * 3, "customer_id string")
    heat = ordered.find_heat(rows, "customer_id", EngineConfig(hot_key_rows=3))
    assert [r.customer_id for r in heat.hot.table.collect()] == ["a"]
    assert heat.nulls and heat.rows == 2


def test_detectors_run_once_for_their_rows(spark):
    rows = vectors(spark, {"large_transaction_flag": True, "high_risk_country_flag": True, "new_country": True}, {})
    long = detectors.findings_long(detectors.rule_hits(rows), "rule_hits")
    below = plan(long).split("Generate", 1)[1]
    assert "Filter" not in below and "filter" not in below.split("\n")[0]
    found = [r.id for r in long.where("transaction_id = 'TXN1'").collect()]
    assert found == ["R001", "R011", "R013", "R020"]
    assert long.where("transaction_id = 'TXN2'").count() == 0


def test_questions_of_one_partition_are_worked_on_by_all_tasks(spark):
    asked = spark.range(0, 100, 1, 1).select(F.col("id").alias("question_id"), F.lit("investigate customer 7 in India, not Indiana").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = triage.triage(asked)
        assert done.rdd.getNumPartitions() == 4
        assert {tuple(r.countries) for r in done.collect()} == {("India",)}
        assert "_lower" not in done.columns
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_run_report_works_alerts_out_once(spark):
    numbered = F.row_number().over(Window.partitionBy("priority").orderBy("id"))
    alerts = spark.range(9).withColumn("priority", F.concat(F.lit("P"), F.col("id") % 2)).withColumn("n", numbered).where("n < 5")
    report = reports.run_report(spark.range(20), alerts)
    assert "Window" not in plan(report)
    assert {r.metric: r.value for r in report.collect()} == {"transactions_processed": 20, "alerts": 8, "alerts_P0": 4, "alerts_P1": 4}


HISTORY = "transaction_id string, customer_id string, timestamp timestamp, amount double, counterparty_account_id long, counterparty_country string, channel string, transaction_type string"


def history(spark):
    rows = [(f"t{i}", [None, "a", "b", "c", "c"][i % 5], at(i * 7 % 90), float(i % 11) if i % 13 else None, i % 4, f"N{i % 3}", "xyz"[i % 3], "RN"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, HISTORY)


def test_profiles_and_features_read_one_exchange_of_the_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = registered.with_history(history(spark)).select("transaction_id", "outside_preferred_hour", "new_country", "profile_unique_beneficiaries")
        steps = rows._jdf.queryExecution().executedPlan().toString()
        assert steps.count("- Exchange hashpartitioning(customer_id") == 1 and steps.count("ReusedExchange") >= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("cfg", [EngineConfig(), EngineConfig(hot_key_rows=15, slice_rows=5)], ids=["plain", "hot"])
def test_rows_dealt_whole_have_the_same_features(spark, cfg):
    rows = history(spark)
    heat = ordered.find_heat(rows, "customer_id", cfg)

    def featured(shared):
        return features.build_features(rows, profiles.build_profiles(rows, cfg=cfg, heat=heat, shared=shared), cfg, heat, shared)

    assert featured(True).columns == featured(False).columns
    same_rows(featured(True), featured(False), "transaction_id")


def test_customers_joined_to_orders_first_give_the_same_lines(spark, tmp_path):
    """Orders without a customer, lines without an order, repeated and missing keys."""
    tables = {
        "nation": spark.createDataFrame([(1, "A"), (2, "B")], "n_nationkey int, n_name string"),
        "customer": spark.createDataFrame([(1, 1), (2, 2), (2, 1), (4, None)], "c_custkey long, c_nationkey int"),
        "supplier": spark.createDataFrame([(7, 2), (8, 1), (None, 1)], "s_suppkey long, s_nationkey int"),
        "orders": spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None), (5, 4), (5, 1), (None, 1)], "o_orderkey long, o_custkey long"),
        "lineitem": spark.createDataFrame(
            [(k, 10 + i, [7, 8, None][i % 3], i, 5.0, float(i), "RN"[i % 2], "O", at(i)) for i, k in enumerate([1, 1, 2, 3, 4, 5, 6, None])],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        rows.createOrReplaceTempView(f"own_{name}")
    found = views.txn_lines(spark, str(tmp_path)).select("transaction_id", "customer_id", "counterparty_country", "location_country")
    want = spark.sql("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, int(l_quantity)), o_custkey, a.n_name, h.n_name
        FROM own_lineitem LEFT JOIN own_orders ON l_orderkey = o_orderkey LEFT JOIN own_customer ON o_custkey = c_custkey LEFT JOIN own_supplier ON l_suppkey = s_suppkey
        LEFT JOIN own_nation h ON c_nationkey = h.n_nationkey LEFT JOIN own_nation a ON s_nationkey = a.n_nationkey""")
    order = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert order(found) == order(want)
    nations = views.nation_flows(spark, str(tmp_path)).select("transaction_id", "src", "dst")
    want = spark.sql("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, int(l_quantity)), IF(l_returnflag = 'R', a.n_name, h.n_name), IF(l_returnflag = 'R', h.n_name, a.n_name)
        FROM own_lineitem JOIN own_orders ON l_orderkey = o_orderkey JOIN own_customer ON o_custkey = c_custkey JOIN own_supplier ON l_suppkey = s_suppkey
        JOIN own_nation h ON c_nationkey = h.n_nationkey JOIN own_nation a ON s_nationkey = a.n_nationkey""")
    assert order(nations) == order(want) and nations.count() == 2
