import pytest
from pyspark.sql import functions as F

from ledgerlight import EngineConfig, FusionWeights
from ledgerlight.operators import actions, alerts, anomaly, detectors, explain, fusion
from tests.helpers import ids_by_row, vectors

RISKY = {
    "transaction_amount": 9500.0, "amount": 9500.0, "amount_z_score": 470.0, "amount_ratio_to_average": 95.0,
    "amount_percentile": 0.99, "large_transaction_flag": True, "transactions_last_hour": 9, "transactions_last_day": 20,
    "time_since_previous_transaction": 0.05, "outside_business_hours": True, "behaviour_deviation_score": 0.9,
    "frequency_deviation_score": 0.9, "amount_deviation_score": 1.0, "new_device": True, "device_switch_flag": True,
    "unique_devices_last_30_days": 4, "new_beneficiary": True, "new_country": True, "cross_border_transaction": True,
    "geographic_change": True, "high_risk_country_flag": True, "pep_flag": True, "previous_sar_count": 2,
    "profile_dormant_customer": True, "profile_cash_intensive_customer": True, "profile_deposit_ratio": 0.6,
    "beneficiary_is_high_frequency": True, "beneficiary_transaction_count": 16, "rolling_average_amount": 300.0,
    "rolling_std_amount": 50.0, "outside_preferred_channel": True, "outside_preferred_hour": True,
    "unusual_weekday": True, "profile_weekend_ratio": 0.01, "profile_business_hours_ratio": 0.95,
    "profile_unique_beneficiaries": 6,
}


def test_normal_rows_have_no_findings(spark):
    found = detectors.all_findings(vectors(spark, {}))
    for column in ("rule_hits", "behaviour_findings", "statistical_findings", "pattern_findings"):
        assert ids_by_row(found, column) == {"TXN1": []}


def test_high_risk_row_triggers_the_families(spark):
    found = detectors.all_findings(vectors(spark, RISKY, RISKY | {"has_profile": False}))
    rules = ids_by_row(found, "rule_hits")
    assert {f"R{i:03d}" for i in range(1, 21)} - {"R008"} <= set(rules["TXN1"])
    assert "R016" not in rules["TXN2"] and "R018" not in rules["TXN2"]
    assert {f"S{i:03d}" for i in range(1, 11)} <= set(ids_by_row(found, "statistical_findings")["TXN1"])
    assert not {"S005", "S006"} & set(ids_by_row(found, "statistical_findings")["TXN2"])
    behaviour = ids_by_row(found, "behaviour_findings")
    assert {f"B{i:03d}" for i in range(1, 11)} <= set(behaviour["TXN1"])
    assert not {"B001", "B002", "B003", "B008"} & set(behaviour["TXN2"])
    patterns = ids_by_row(found, "pattern_findings")
    assert {f"P{i:03d}" for i in range(1, 16)} - {"P002", "P006"} <= set(patterns["TXN1"])
    assert not {"P003", "P007", "P010"} & set(patterns["TXN2"]) and "P002" in patterns["TXN2"]


BOUNDARIES = [
    ("rule_hits", "R002", {"amount_z_score": 3.01}, {"amount_z_score": 3.0}),
    ("rule_hits", "R003", {"transactions_last_hour": 5}, {"transactions_last_hour": 4, "transactions_last_day": 14}),
    ("rule_hits", "R004", {"behaviour_deviation_score": 0.71}, {"behaviour_deviation_score": 0.7}),
    ("rule_hits", "R015", {"previous_sar_count": 1}, {"previous_sar_count": 0}),
    ("rule_hits", "R017", {"transaction_amount": 8000.0, "transactions_last_day": 3},
     {"transaction_amount": 10000.0, "transactions_last_day": 3}),
    ("rule_hits", "R017", {"transaction_amount": 9999.99, "transactions_last_day": 3},
     {"transaction_amount": 9999.99, "transactions_last_day": 2}),
    ("statistical_findings", "S002", {"amount_percentile": 0.951}, {"amount_percentile": 0.95}),
    ("statistical_findings", "S003", {"transaction_amount": 201.0}, {"transaction_amount": 200.0}),
    ("statistical_findings", "S006", {"transactions_last_hour": 3, "profile_avg_daily_txns": 14.0},
     {"transactions_last_hour": 3, "profile_avg_daily_txns": 14.5}),
    ("statistical_findings", "S007", {"time_since_previous_transaction": 2.3}, {"time_since_previous_transaction": 2.5}),
    ("statistical_findings", "S009", {"transaction_amount": 200.5}, {"transaction_amount": 200.0}),
    ("behaviour_findings", "B005", {"amount_deviation_score": 0.61}, {"amount_deviation_score": 0.6}),
    ("pattern_findings", "P012", {"beneficiary_is_high_frequency": True, "beneficiary_transaction_count": 16},
     {"beneficiary_is_high_frequency": True, "beneficiary_transaction_count": 15}),
    ("pattern_findings", "P013", {"transactions_last_hour": 8, "time_since_previous_transaction": 0.09},
     {"transactions_last_hour": 8, "time_since_previous_transaction": 0.1}),
    ("pattern_findings", "P006", {"transactions_last_day": 15, "amount_deviation_score": 0.19},
     {"transactions_last_day": 15, "amount_deviation_score": 0.2}),
]


def test_boundaries(spark):
    rows = [c for _, _, hit, miss in BOUNDARIES for c in (hit, miss)]
    found = detectors.all_findings(vectors(spark, *rows)).persist()
    for i, (column, code, _, _) in enumerate(BOUNDARIES):
        got = ids_by_row(found, column)
        assert code in got[f"TXN{2 * i + 1}"], code
        assert code not in got[f"TXN{2 * i + 2}"], code


def test_circular_hour_distance(spark):
    rows = vectors(spark, {"outside_preferred_hour": True, "profile_preferred_hour": 23})
    row = detectors.findings_long(detectors.behaviour_findings(rows), "behaviour_findings").first()
    assert row.id == "B001" and row.deviation == 11.0  # 10 o'clock is 13 hours before 23, 11 after


def finding(spark, family, rows):
    return spark.createDataFrame(rows, "transaction_id string, customer_id string, id string, name string, severity string, score double, confidence double")


def assessed(spark):
    """R001 80 + R013 95, B009 80, S001 75, ML confidence 0.90, P008 critical."""
    base = spark.createDataFrame([("TXN1", "C1")], "transaction_id string, customer_id string")

    def one(i, name, severity, score, confidence):
        return (f"struct('{i}' id, '{name}' name, '{severity}' severity, {score}D score, {confidence}D confidence, 0D deviation, "
                "'' reason, cast(map() as map<string,string>) evidence)")

    return base.withColumns({
        "rule_hits": F.expr(f"array({one('R001', 'Large Transaction', 'HIGH', 80, 0.8)}, {one('R013', 'High Risk Country', 'CRITICAL', 95, 0.8)})"),
        "behaviour_findings": F.expr(f"array({one('B009', 'Country Behaviour Change', 'HIGH', 80, 0.8)})"),
        "statistical_findings": F.expr(f"array({one('S001', 'Amount Z-Score', 'HIGH', 75, 0.8)})"),
        "ml_findings": F.expr(f"array({one('ML-1', 'IsolationForest_v1', 'HIGH', 0.2, 0.9)})"),
        "pattern_findings": F.expr(f"array({one('P008', 'Cross-Border Layering', 'CRITICAL', 0, 0.95)})"),
    })


def test_fusion_of_all_families(spark):
    row = fusion.fuse(assessed(spark)).first()
    # 100*.3 + 80*.2 + 75*.15 + 90*.15 + 100*.2
    assert row.overall_risk_score == pytest.approx(90.75)
    assert row.confidence_score == pytest.approx(0.6 * 100 + 0.4 * 92.5)
    assert row.risk_level == "CRITICAL" and row.risk_breakdown["Rule"] == "30.0%"
    assert row.top_reasons == ["Large Transaction", "High Risk Country", "Cross-Border Layering", "Country Behaviour Change", "Amount Z-Score"]


def test_fusion_of_rules_only(spark):
    row = fusion.fuse(assessed(spark).select("transaction_id", "customer_id", "rule_hits")).first()
    assert row.engine_weights["Rule"] == 1.0 and row.overall_risk_score == 100.0
    assert row.confidence_score == 55.0 and row.engine_weights["ML"] == 0.0


def test_rows_without_findings_are_left_out(spark):
    found = detectors.all_findings(vectors(spark, {}, RISKY))
    assert [r.transaction_id for r in fusion.fuse(found).collect()] == ["TXN2"]
    kept = {r.transaction_id: r for r in fusion.fuse(found, keep_all=True).collect()}
    assert kept["TXN1"].overall_risk_score == 0.0 and kept["TXN1"].confidence_score == 100.0 and kept["TXN1"].risk_level == "LOW"
    assert sum(kept["TXN2"].engine_weights.values()) == pytest.approx(1.0, abs=1e-3)


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        FusionWeights(rule=0.5)


def test_findings_regrouped_from_rows(spark):
    found = detectors.all_findings(vectors(spark, RISKY))
    long = {f: detectors.findings_long(found, c) for f, c in fusion.COLUMNS.items() if f != "ml"}
    back, direct = fusion.fuse(fusion.gather_findings(long)).first(), fusion.fuse(found).first()
    assert back.overall_risk_score == direct.overall_risk_score and back.top_reasons == direct.top_reasons
    copies = {f: df.unionByName(df) for f, df in long.items()}
    assert fusion.fuse(fusion.gather_findings(copies)).first().top_reasons == direct.top_reasons


def test_explanation(spark):
    row = explain.explain(fusion.fuse(assessed(spark))).first()
    assert "CRITICAL RISK" in row.narrative and "ML Anomaly: IsolationForest_v1" in row.narrative and "5 independent" in row.narrative
    assert [f.type for f in row.contributing_factors] == ["rule", "rule", "behaviour", "statistical", "ml", "pattern"]
    assert row.contributing_factors[-1].score == 0.95 and row.matched_patterns == ["Cross-Border Layering"]


@pytest.mark.parametrize("score, level, actions_wanted", [
    (92.0, "CRITICAL", ["FILE_SAR", "FREEZE_ACCOUNT"]), (65.0, "VERY HIGH", ["ESCALATE_TO_COMPLIANCE"]),
    (45.0, "HIGH", ["ESCALATE_TO_COMPLIANCE"]), (25.0, "MEDIUM", ["REQUEST_DOCUMENTS"]), (5.0, "LOW", ["MONITOR_ACCOUNT"]),
    (85.0, "LOW", ["FILE_SAR", "FREEZE_ACCOUNT"]),
])
def test_primary_actions(spark, score, level, actions_wanted):
    rows = spark.createDataFrame(
        [("t", "c", score, level, ["r"], [], ["why"])],
        "transaction_id string, customer_id string, overall_risk_score double, risk_level string, "
        "triggered_rules array<string>, triggered_patterns array<string>, top_reasons array<string>",
    )
    assert [r.action for r in actions.recommend(rows).first().recommendations] == actions_wanted


def test_supplementary_actions_in_priority_order(spark):
    recs = actions.recommend(fusion.fuse(assessed(spark))).first().recommendations
    assert [r.priority for r in recs] == sorted(r.priority for r in recs)
    assert [r.title for r in recs] == [
        "File Suspicious Activity Report", "Freeze Transaction Pending Investigation", "Refresh Customer KYC",
        "Verify Source of Funds", "Review Historical Transactions", "Review Related Accounts",
    ]


def alert_input(spark, rows):
    base = spark.createDataFrame(rows, "transaction_id string, customer_id string, overall_risk_score double, confidence_score double, risk_level string")
    texts = F.array().cast("array<string>")
    return actions.recommend(explain.explain(fusion.with_families(
        base.withColumns({"triggered_rules": texts, "triggered_patterns": texts, "top_reasons": texts}))))


def test_alert_ranking_dedupe_and_cap(spark):
    rows = [("a", "c", 92.0, 50.0, "CRITICAL"), ("b", "c", 77.0, 50.0, "VERY HIGH"), ("c", "c", 55.0, 60.0, "HIGH"),
            ("d", "c", 10.0, 50.0, "LOW"), ("e", "c", 55.0, 70.0, "HIGH"), ("a", "c", 60.0, 50.0, "HIGH"), ("", "c", 99.0, 50.0, "CRITICAL"),
            ("f", "c", 55.0, 60.0, "HIGH")]
    got = alerts.prioritise(alert_input(spark, rows)).collect()
    assert [r.transaction_id for r in got] == ["a", "b", "e", "c", "f", "d"]
    assert [r.priority for r in got] == ["P1_CRITICAL", "P2_HIGH", "P3_MEDIUM", "P3_MEDIUM", "P3_MEDIUM", "P4_LOW"]
    assert got[0].fused_risk_score == 92.0 and len({r.alert_id for r in got}) == 6
    assert alerts.prioritise(alert_input(spark, rows), EngineConfig(max_alerts=2)).count() == 2


def test_two_pass_alerts_equal_one_pass(spark, sf):
    from ledgerlight.plans import detection
    from ledgerlight.sources.driver_views import txn_events

    rows, cfg = txn_events(spark, sf), EngineConfig(max_alerts=25)
    one = alerts.prioritise(actions.recommend(explain.explain(detection.assess(rows, cfg=cfg))), cfg).collect()
    assert detection.detect_alerts(rows, cfg=cfg).collect() == one
    nobody = rows.selectExpr("* EXCEPT (customer_id)", "IF(transaction_id % 3 = 0, NULL, customer_id) AS customer_id", "'IR' AS counterparty_country")
    one = alerts.prioritise(actions.recommend(explain.explain(detection.assess(nobody, cfg=cfg))), EngineConfig(max_alerts=10**6)).collect()
    two = detection.detect_alerts(nobody, cfg=EngineConfig(max_alerts=2000)).collect()
    assert two == one[:2000] and any(r.customer_id is None for r in one)
    few = nobody.where("transaction_id < 5").select("transaction_id")
    assert {r.transaction_id for r in detection.investigate(nobody, transaction_ids=few).collect()} == {r.transaction_id for r in one if r.transaction_id < 5}


def test_anomaly_model(spark, tmp_path):
    rows = vectors(spark, *[{"amount_z_score": 0.2 + i / 100, "rolling_average_amount": 100.0 + i % 7} for i in range(60)],
                   {"amount_z_score": 50.0, "rolling_average_amount": 9e4, "transactions_last_day": 90, "transactions_last_hour": 40})
    cfg = EngineConfig(trees=20, contamination=0.02)
    model = anomaly.fit_or_load(rows, str(tmp_path / "model"), cfg)
    found = detectors.findings_long(model.transform(rows, cfg), "ml_findings").collect()
    assert "TXN61" in {r.transaction_id for r in found} and len(found) <= 2
    assert all(0 <= r.confidence <= 1 and r.score > 0 for r in found)
    again = anomaly.fit_or_load(rows, str(tmp_path / "model"), cfg)
    key = lambda m: sorted((r.transaction_id, round(r.isolation_score, 12)) for r in m.score(rows).collect())
    assert key(model) == key(again)
    per_tree = anomaly.tree_samples(rows, 61, cfg, anomaly.FEATURES).groupBy("tree").count().collect()
    assert len(per_tree) == 20 and all(r["count"] <= cfg.tree_sample for r in per_tree)


def test_forest_is_the_one_that_sql_grows(spark):
    import duckdb
    import pandas as pd

    from ledgerlight.plans import oracle_parts

    hard = [None, float("nan"), float("inf"), -3.25, 1e14, 0.00005, -0.00005, 7.0]
    rows = vectors(spark, *[
        {"amount_z_score": hard[i % 8], "rolling_average_amount": (i * i % 331) / 7, "historical_max_amount": -float(i % 5), "transactions_last_day": i % 11}
        for i in range(1100)
    ])
    cfg = EngineConfig()
    model = anomaly.fit(rows, cfg)
    got = {r.transaction_id: r.isolation_score for r in model.score(rows).collect()}
    db = duckdb.connect()
    db.register("t", pd.DataFrame([r.asDict() for r in rows.select("transaction_id", *anomaly.FEATURES).collect()]))
    parts = f"WITH RECURSIVE {oracle_parts.forest(anomaly.FEATURES, 't')}"
    assert dict(db.execute(f"{parts} SELECT transaction_id, score FROM scored").fetchall()) == got
    assert db.execute(f"{parts} SELECT cut FROM model_cut").fetchone()[0] == pytest.approx(model.cut, abs=1e-12)


def test_forest_samples(spark):
    """Whatever the table holds: full samples for every tree, no row twice in one tree, one order of rows where that is enough."""
    rows = vectors(spark, *[{"amount_z_score": float(i)} for i in range(900)])
    for cfg, shared, orders in ((EngineConfig(trees=7, tree_sample=100), 7, 1), (EngineConfig(trees=20, tree_sample=100), 9, 3), (EngineConfig(trees=3, tree_sample=2000), 1, 3)):
        assert anomaly.passes(900, cfg) == (shared, orders)
        found = anomaly.tree_samples(rows, 900, cfg, ("amount_z_score",)).collect()
        by_tree = {}
        for r in found:
            by_tree.setdefault(r.tree, []).append(r.x[0])
        assert sorted(by_tree) == list(range(cfg.trees))
        assert all(len(x) == len(set(x)) == min(900, cfg.tree_sample) for x in by_tree.values())
        if orders == 1:
            assert len({v for x in by_tree.values() for v in x}) == 700


def test_counted_alerts_carry_no_texts(spark):
    """Where only ranked columns are used, findings and texts are neither worked out nor sorted with the copies; ties keep one row."""
    assessed = actions.recommend(explain.explain(fusion.fuse(detectors.all_findings(vectors(spark, RISKY, RISKY)))))
    twice = assessed.unionByName(assessed)
    counts = alerts.build_alerts(twice).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "narrative" not in plan
    assert sum(r.n for r in counts.collect()) == 2
    whole = alerts.build_alerts(twice)
    assert whole.count() == 2 and all(r.narrative and r.top_reasons and r.triggered_rules for r in whole.collect())
    assert "profile_unique_beneficiaries" not in next(x for x in whole._jdf.queryExecution().optimizedPlan().toString().splitlines() if "max_by" in x)
