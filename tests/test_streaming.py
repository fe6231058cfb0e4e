import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import detectors, features, profiles
from ledgerlight.sources.driver_views import txn_events
from ledgerlight.streaming import live
from tests.helpers import at


def drain(query_name, df, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(query_name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(query_name)


def stream(spark, sf, tmp_path):
    rows = txn_events(spark, sf).orderBy("timestamp").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    return rows, live.transaction_stream(spark, str(tmp_path / "in"), rows.schema)


def test_sliding_counts_match_a_batch(spark, sf, tmp_path):
    rows, arriving = stream(spark, sf, tmp_path)
    got = drain("sliding", live.sliding_velocity(arriving), "complete")
    batch = rows.groupBy("customer_id", F.window("timestamp", "1 hour", "15 minutes").alias("w")).count()
    assert got.count() == batch.count() and got.agg(F.sum("transactions")).first() == batch.agg(F.sum("count")).first()


def test_scoring_against_a_snapshot(spark, sf, tmp_path):
    rows, arriving = stream(spark, sf, tmp_path)
    history = profiles.build_profiles(rows, as_of="2024-01-16")
    got = drain("scored", live.score_against_profiles(arriving, history))
    limits = rows.where("timestamp < '2024-01-16'").groupBy("customer_id").agg(F.max("amount").alias("m"))
    wanted = rows.join(limits, "customer_id").where("amount > m").count()
    assert got.count() == rows.count() and got.where("above_history").count() == wanted


def in_files(spark, folder, rows, schema, cuts):
    """The rows as files that arrive one after another, whatever their times."""
    frame = spark.createDataFrame(rows, schema)
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(folder)
    return live.transaction_stream(spark, folder, frame.schema, files_per_trigger=1)


TXN = "transaction_id string, customer_id string, timestamp timestamp, amount double"


def test_trailing_counts_of_shuffled_batches(spark, tmp_path):
    """Rows out of order within the watermark, peers, null amounts and customers; each complete row once, as a batch counts it."""
    rng = random.Random(3)
    rows = [(f"t{i}", rng.choice(["a", "b", None]), at(i / 8 + rng.uniform(-0.7, 0.7) if i % 5 else i // 8), None if i % 9 == 0 else float(i)) for i in range(400)]
    rows += [("late", "a", at(1), 5.0)]
    arriving = in_files(spark, str(tmp_path / "in"), rows, TXN, [100, 200, 300])
    got = {r.transaction_id: r for r in drain("trailing", live.trailing_counts(arriving)).collect()}
    due = max(r[2] for r in rows) - dt.timedelta(hours=2)
    whole = [r for r in rows if r[1] is not None and r[0] != "late"]
    assert set(got) == {r[0] for r in whole if r[2] <= due.replace(microsecond=due.microsecond // 1000 * 1000)}
    for i, who, when, _ in whole:
        if i in got:
            near = lambda h: [r[3] for r in whole if r[1] == who and r[3] is not None and when - dt.timedelta(hours=h) < r[2] <= when]
            row = got[i]
            assert (row.transactions_last_hour, row.transactions_last_day) == (len(near(1)), len(near(24)))
            assert row.amount_last_day == (pytest.approx(sum(near(24))) if near(24) else None)


def test_suppression_starts_anew_only_when_an_alert_is_sent(spark, tmp_path):
    alerts = [("b2", "d", 1, "P3"), ("b1", "d", 0, None), ("a2", "c", 20, "P2"), ("a1", "c", 0, "P2"), ("a3", "c", 25, "P3"), ("a4", "c", 30, "P1"), ("a5", "c", 53, "P2"), ("a6", "c", 54, "P2"), ("z", "e", 400, "P1")]
    rows = [(i, c, at(h), p) for i, c, h, p in alerts]
    arriving = in_files(spark, str(tmp_path / "in"), rows, "alert_id string, customer_id string, timestamp timestamp, priority string", [5, 6])
    got = {r.alert_id for r in drain("sent", live.suppress_repeats(arriving)).collect()}
    # a2 is held back by a1; a3 comes a day after a1, which was the last one sent; a4 and b2 are higher than what held them back
    assert got == {"a1", "a3", "a4", "a6", "b1", "b2"}


def test_detectors_survive_a_restart(spark, sf, tmp_path):
    rows = txn_events(spark, sf).orderBy("timestamp")
    rows.where("transaction_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    versions = profiles.build_profiles(rows, as_of="2024-01-16").withColumn("valid_from", F.lit("2024-01-16").cast("timestamp")).checkpoint()
    folder = str(tmp_path / "out")

    def run(detect):
        arriving = live.transaction_stream(spark, str(tmp_path / "in"), rows.schema)
        live.score_stream(arriving, lambda: versions, detect, folder, str(tmp_path / "state")).awaitTermination()

    run(live.batch_findings)
    rows.where("transaction_id % 2 = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def broken(batch, profiles):
        batch.sparkSession.createDataFrame([("lost", "X", "LOW", 1.0, 1.0)], "transaction_id string, id string, severity string, score double, confidence double").write.parquet(f"{folder}/batch=1")
        raise RuntimeError("power cut")

    with pytest.raises(Exception, match="power cut"):
        run(broken)
    run(live.batch_findings)
    got = spark.read.parquet(folder)
    ids = {r.id for r in got.select("id").distinct().collect()}
    want = live.batch_findings(rows, versions)
    key = lambda df: sorted((str(r.transaction_id), r.id, r.severity, r.score, r.confidence) for r in df.collect())
    assert key(got) == key(want) and {"R001", "R005", "R006", "S001", "S009", "B001"} <= ids
    # the same detectors in a batch with all features and the same profiles
    history = profiles.build_profiles(rows, as_of="2024-01-16")
    full = detectors.all_findings(features.build_features(rows.where("timestamp >= '2024-01-16'"), history))
    alone = {d.id for own, _, _ in live.without_look_back(full).values() for d in own}
    batch = [(str(r.transaction_id), f.id) for r in full.collect() for c in ("rule_hits", "behaviour_findings", "statistical_findings", "pattern_findings") for f in r[c] if f.id in alone]
    later = {str(r.transaction_id) for r in rows.where("timestamp >= '2024-01-16'").collect()}
    with_history = {r.customer_id for r in history.collect()}
    known = {str(r.transaction_id) for r in rows.collect() if r.customer_id in with_history}
    assert sorted(x for x in batch if x[0] in known) == sorted((t, i) for t, i, *_ in key(got) if t in later & known)
