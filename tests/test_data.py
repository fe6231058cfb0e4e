import pytest
from pyspark.sql import functions as F

from ledgerlight import EngineConfig, schemas
from ledgerlight.operators import cleaning, enrichment, quality, reports
from ledgerlight.sources import catalogue, sinks
from tests.helpers import at


def tables(spark):
    txn = spark.createDataFrame(
        [("t1", "a1", "c1", "2024-01-01 10:00:00", "100.5", "US"), ("t2", "a1", "c1", "2024-01-06 20:00:00", None, "IR"),
         ("t2", "a1", "c1", "2024-01-06 20:00:00", None, "IR")],
        "transaction_id string, account_id string, customer_id string, timestamp string, amount string, counterparty_country string",
    )
    customer = spark.createDataFrame(
        [("c1", "1990-01-01", "34", "true", "Retail", "1000", "High", "0", "5")],
        "customer_id string, dob string, age string, is_pep string, profile_segment string, annual_income string, "
        "kyc_level string, sanctions_hit string, risk_score string",
    )
    account = spark.createDataFrame(
        [("a1", "c1", "2023-12-02", "Active", "500")],
        "account_id string, customer_id string, open_date string, status string, avg_monthly_balance string",
    )
    country = spark.createDataFrame([("US", "Normal", 0.1), ("IR", "Black", 1.0)], "country_code string, fatf_status string, risk_score double")
    return {"transaction": txn, "customer": customer, "account": account, "country_risk": country}


def test_preprocess_chain(spark):
    rows = cleaning.preprocess(tables(spark)).orderBy("transaction_id").collect()
    assert [r.transaction_id for r in rows] == ["t1", "t2"] and rows[1].amount == 100.5
    assert rows[0].customer_age_group == "31-50" and rows[0].account_age_days == 30 and rows[0].is_pep is True
    assert rows[0].is_business_hours and not rows[1].is_business_hours and rows[1].is_weekend
    assert rows[1].fatf_status == "Black" and rows[0].sanctions_hit is False and rows[0].account_status == "Active"


def test_preprocess_refuses_empty_tables(spark):
    given = tables(spark)
    given["transaction"] = given["transaction"].limit(0)
    with pytest.raises(ValueError, match="empty DataFrame"):
        cleaning.preprocess(given)


def test_text_types_and_dates(spark):
    rows = spark.createDataFrame([("  a\x07 b \n c ", "x1", "2024-01-01"), (None, "2.7", "invalid_date")], "full_name string, age string, dob string")
    done = cleaning.normalise_types(cleaning.clean_strings(rows), "customer").collect()
    assert done[0].full_name == "a b c" and done[1].full_name is None
    assert done[0].age is None and done[1].age == 2
    assert done[0].dob is not None and done[1].dob is None


def test_impute_leaves_identifiers_and_dates(spark):
    rows = spark.createDataFrame(
        [("d1", 1.0, "x", True, None), (None, 3.0, "y", None, at(1)), ("d1", None, None, None, at(2)), ("d2", 9.0, "y", None, at(3)), ("d2", None, "x", None, at(3))],
        "device_id string, amount double, channel string, flag boolean, when timestamp",
    )
    got = cleaning.impute(rows).collect()
    assert sorted(r.amount for r in got) == [1.0, 3.0, 3.0, 3.0, 9.0]
    assert [r.channel for r in got].count("x") == 3 and sum(r.flag for r in got) == 1
    assert sum(r.device_id is None for r in got) == 1 and sum(r.when is None for r in got) == 1
    nothing = spark.createDataFrame([(None, None)], "a double, b string")
    assert cleaning.impute(nothing).first() == (0.0, "UNKNOWN")


def test_sparse_columns_are_reported_and_dropped_on_request(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, "v", "y")], "a int, b string, c string")
    assert cleaning.sparse_columns(rows) == ["b"] and cleaning.drop_sparse_columns(rows).columns == ["a", "c"]


def test_validation_reports(spark):
    child = spark.createDataFrame([(1,), (1,), (7,), (8,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    strict = quality.foreign_key_check(child, "k", parent, "k", "child", "parent", allow_nulls=False).first()
    loose = quality.foreign_key_check(child, "k", parent, "k").first()
    assert strict.violations == 3 and loose.violations == 2 and loose["sample"] == "7,8"
    assert quality.unique_check(child, "k").first().violations == 1
    assert quality.not_empty_check(child.limit(0)).first().violations == 1
    low = quality.range_check(spark.createDataFrame([(0.0,), (-2.0,), (5.0,)], "v double"), "v", low=0.01).first()
    assert (low.violations, low["sample"]) == (2, "-2.0")
    stamps = spark.createDataFrame([("2024-01-01",), ("nope",), (None,)], "t string")
    assert quality.timestamp_check(stamps, "t").first().violations == 1
    assert quality.dtype_mismatches(parent, {"k": "double"}) == ["k: expected double, found int"]
    with pytest.raises(quality.ValidationError, match="unique"):
        quality.require(quality.unique_check(child, "k", "child"))


def test_acceptance_report(spark):
    txn = spark.createDataFrame(
        [("t1", "a1", "c1", "a2", 5.0, "Normal", None), ("t2", "a1", "c1", None, -1.0, "Suspicious", "Smurfing")],
        "transaction_id string, account_id string, customer_id string, counterparty_account_id string, balance_after double, "
        "flag_label string, aml_scenario_tag string",
    )
    accounts = spark.createDataFrame([("a1", "c1"), ("a2", "c9")], "account_id string, customer_id string")
    customers = spark.createDataFrame([("c1",)], "customer_id string")
    got = {r.check: (r.passed, r.detail) for r in quality.acceptance_report(txn, accounts, customers, 2).collect()}
    assert got["transaction.account_id -> account"][0] and not got["account.customer_id -> customer"][0]
    assert got["no negative balance"] == (False, "negative=1") and got["scenario Smurfing"] == (False, "actual=1")
    assert got["OVERALL"] == (False, "FAIL")


def test_relationship_degree(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "customer_id_1 string, customer_id_2 string")
    got = {r.customer_id: r.relationship_degree for r in enrichment.relationship_degree(pairs).collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "d": 2}
    customers = spark.createDataFrame([("a",), ("x",)], "customer_id string")
    assert {tuple(r) for r in enrichment.with_relationship_degree(customers, pairs).collect()} == {("a", 2), ("x", 0)}


def test_catalogue_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    for table, columns in schemas.TABLES.items():
        header = ",".join(columns)
        value = {"str": "k1", "num": "1.5", "int": "3", "bool": "True", "ts": "2024-01-01"}
        line = ",".join(value[k] for k in columns.values())
        (tmp_path / f"{table}.csv").write_text(f"{header}\n{line}\n")
    loaded = catalogue.load_catalogue(spark, folder)
    assert loaded["transaction"].first().amount == 1.5 and loaded["location"].first().is_high_risk is True
    meta = {r.table: (r.rows, r.columns) for r in catalogue.table_metadata(loaded).collect()}
    assert meta["transaction"] == (1, 17) and len(meta) == 12
    assert "_corrupt_record" not in loaded["transaction"].columns
    good = (tmp_path / "transaction.csv").read_text()
    (tmp_path / "transaction.csv").write_text(good + good.splitlines()[1].replace("2024-01-01", "not-a-date").replace("k1", "k2", 1) + "\n")
    with pytest.raises(quality.ValidationError, match="transaction.* readable: 1"):
        catalogue.load_catalogue(spark, folder)
    assert catalogue.load_catalogue(spark, folder, check=False)["transaction"].where("timestamp IS NULL").count() == 1
    raw = catalogue.load_catalogue(spark, folder, raw=True, check=False)
    assert dict(raw["transaction"].dtypes)["amount"] == "string"
    with pytest.raises(Exception):
        catalogue.read_csv(spark, folder + "/none.csv", "branch").count()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", at(0))], "a int, b string, timestamp timestamp")
    sinks.save_table(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    sinks.save_transactions(rows, str(tmp_path / "t"))
    assert (tmp_path / "t" / "transaction_date=2024-01-01").exists()
    sinks.save_json(rows, str(tmp_path / "j"))
    assert catalogue.read_json(spark, str(tmp_path / "j")).first().b == "x"
    with pytest.raises(ValueError):
        sinks.save_table(rows, str(tmp_path / "x"), "xlsx")


def test_learning_log(spark):
    log = spark.createDataFrame([("e1", "s1", "COMPLETED", 1.0), ("e2", "s1", "FAILED", 2.0), ("e3", "s2", "PARTIAL_SUCCESS", 3.0)],
                                "execution_id string, session_id string, status string, duration_seconds double")
    feedback = spark.createDataFrame([("e1", "FALSE_POSITIVE", "", 1), ("e1", "TRUE_POSITIVE", "ok", 2)],
                                     "execution_id string, feedback_type string, investigator_notes string, at int")
    row = reports.learning_summary(reports.with_feedback(log, feedback)).first()
    assert (row.total_executions, row.completed_executions, row.failed_executions, row.partial_success_executions) == (3, 1, 1, 1)
    assert (row.feedback_true_positive, row.feedback_false_positive, row.notes, row.average_duration) == (1, 0, 1, 2.0)
    with pytest.raises(ValueError, match="duplicate"):
        reports.record_executions(log, log.limit(1))
    with pytest.raises(ValueError, match="negative"):
        reports.record_executions(log.limit(0), log.withColumn("duration_seconds", F.lit(-1.0)))
    assert reports.session_history(log, "s1").count() == 2
    empty = reports.learning_summary(reports.with_feedback(log.limit(0), feedback)).first()
    assert empty.total_executions == 0 and empty.average_duration == 0.0


def test_alert_serving(spark):
    alerts = spark.createDataFrame(
        [("A1", "c1", "P1_CRITICAL", "CRITICAL", 95.0, 9.0, "OPEN", "t1"), ("A2", "c2", "P3_MEDIUM", "HIGH", 60.0, 9.0, "OPEN", "t2")],
        "alert_id string, customer_id string, priority string, risk_level string, fused_risk_score double, confidence_score double, status string, transaction_id string",
    )
    assert [r.alert_id for r in reports.alert_query(alerts, "P2_HIGH").collect()] == ["A1"]
    assert [r.alert_id for r in reports.alert_query(alerts, limit=1, offset=1).collect()] == ["A2"]
    assert reports.search(alerts, "C2").count() == 1 and reports.search(alerts, "", status="OPEN").count() == 2
    events = spark.createDataFrame([("A1", "REVIEW", 1), ("A1", "CLOSED", 2)], "alert_id string, status string, at int")
    row = reports.kpi_summary(reports.latest_status(alerts, events)).first()
    assert (row.total_alerts, row.closed_alerts, row.open_alerts, row.resolution_rate) == (2, 1, 1, 50.0)
    assert reports.filter_alerts(alerts, level="high", limit=5).count() == 1
    assert reports.customer_risk(alerts).count() == 2
    assert EngineConfig().max_alerts == 1000


def test_key_report_of_several_tables(spark):
    """Null keys, keys of two children in one domain, a table that refers to itself, numeric order of samples."""
    people = spark.createDataFrame([("1", "2"), ("2", "9"), ("2", None), (None, "10")], "id string, owner string")
    cards = spark.createDataFrame([(1,), (3,), (None,), (20,), (20,)], "person int")
    got = {(r.table, r.check, r.column): (r.violations, r.sample) for r in quality.key_report(
        {"people": people, "cards": cards, "empty": cards.limit(0)}, {"people": "id", "empty": "person"},
        [("people", "owner", "people", "id", True), ("cards", "person", "people", "id", False), ("people", "id", "empty", "person", True), ("cards", "person", "absent", "x", True)],
    ).collect()}
    assert got == {
        ("people", "unique", "id"): (1, "2"), ("empty", "unique", "person"): (0, None),
        ("people", "foreign_key->people.id", "owner"): (2, "10,9"), ("cards", "foreign_key->people.id", "person"): (4, "20,3"),
        ("people", "foreign_key->empty.person", "id"): (3, "1,2"),
    }


def test_cleaning_reports_itself(spark):
    rows = spark.createDataFrame([("c1", " a ", "1"), ("c1", " a ", "1"), (None, None, None), ("c2", None, "x")], "customer_id string, full_name string, age string")
    saved, report = cleaning.clean_and_report(rows, "customer")
    exact = cleaning.quality_report(rows, cleaning.clean_table(rows, "customer"), "customer").drop("table").first().asDict()
    assert report == exact and exact["duplicates_removed"] == 1 and saved.count() == exact["rows_out"] == 2


def test_fills_of_many_columns_at_once(spark):
    rows = spark.createDataFrame([(1, 4.0, "b", None, None), (2, None, "a", True, None), (4, 8.0, "b", None, None), (None, 6.0, "a", None, None)], "n int, x double, t string, f boolean, gone string")
    assert cleaning.fill_values(rows, ["n", "x", "t", "f", "gone"]) == {"n": 2.0, "x": 6.0, "t": "a", "f": False, "gone": "UNKNOWN"}
    assert cleaning.fill_values(rows.limit(0), ["x", "t"]) == {"x": 0.0, "t": "UNKNOWN"} and cleaning.fill_values(rows, ["f"]) == {"f": False}
