import random

import pytest
from pyspark.sql import functions as F

from ledgerlight import EngineConfig
from ledgerlight.operators import typologies as t
from tests.helpers import at

EDGE = "transaction_id string, src string, dst string, timestamp timestamp, amount double"
HOT = EngineConfig(hot_key_rows=3, slice_rows=2)
CONFIGS = pytest.mark.parametrize("cfg", [EngineConfig(), HOT], ids=["plain", "hot"])


def edges(spark, *rows):
    return spark.createDataFrame([(f"e{i}", *r[:2], at(r[2]), float(r[3])) for i, r in enumerate(rows, 1)], EDGE)


def ids(df, column="transaction_id"):
    return {r[column] for r in df.collect()}


@CONFIGS
def test_structuring_band_and_window(spark, cfg):
    rows = [("a", h, amount, kind) for h, amount, kind in
            [(0, 900_000, "Credit"), (48, 950_000, "Credit"), (119, 860_000, "Credit"), (119, 990_000, "Credit"), (100, 900_000, "Debit")]]
    rows += [("b", h, 900_000, "Credit") for h in (0, 60, 121)]
    df = spark.createDataFrame([(f"t{i}", a, at(h), float(m), k) for i, (a, h, m, k) in enumerate(rows)],
                               "transaction_id string, account_id string, timestamp timestamp, amount double, transaction_type string")
    assert ids(t.structuring(df, cfg=cfg)) == {"t2"}


@CONFIGS
def test_smurfing_needs_four_senders_in_time(spark, cfg):
    near = edges(spark, *[(f"s{i % 3}", "x", i, 10) for i in range(8)])
    assert t.smurfing(near, cfg).count() == 0
    hit = edges(spark, ("s1", "x", 0, 1), ("s2", "x", 10, 1), ("s3", "x", 20, 1), ("s4", "x", 47, 1), ("s1", "x", 49, 1), ("s5", "y", 47, 1))
    # at hour 49 the first payment has left the window, but its sender pays again
    assert ids(t.smurfing(hit, cfg)) == {"e4", "e5"}
    late = edges(spark, ("s1", "x", 0, 1), ("s2", "x", 10, 1), ("s3", "x", 20, 1), ("s4", "x", 48, 1))
    assert t.smurfing(late, cfg).count() == 0


def test_layering_chain_and_near_misses(spark):
    chain = edges(spark, ("A", "B", 0, 1000), ("B", "C", 5, 950), ("C", "D", 9, 900), ("C", "D", 9, 700), ("D", "E", 8, 860), ("B", "Z", 200, 950))
    assert ids(t.layering_chains(chain)) == {"e3"}
    # the last hop of A-B-C-D-E is earlier than the one before it
    assert ids(t.layering_chains(chain, ordered=False)) == {"e3", "e5"}


def test_cycles(spark):
    ring = edges(spark, ("A", "B", 0, 100), ("B", "C", 2, 100), ("C", "A", 4, 99), ("C", "D", 4, 99), ("B", "A", 3, 98), ("X", "X", 1, 5))
    found = t.circular_flows(ring).collect()
    assert [r.transactions for r in found] == [["e1", "e2", "e3"]] and found[0].accounts == ["A", "B", "C"]
    assert t.circular_flows(ring, hours=1).count() == 0
    shuffled = edges(spark, ("A", "B", 4, 100), ("B", "C", 0, 100), ("C", "A", 2, 100))
    assert t.circular_flows(shuffled, ordered=False).count() == 1


def test_chains_and_cycles_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randint(0, 4)}", f"n{rng.randint(0, 4)}", rng.randint(0, 60), rng.choice([100, 96, 92, 89, 85])) for _ in range(60)]
    df = edges(spark, *rows)
    cfg = EngineConfig(hop_hours=24)
    data = [(f"e{i}", *r) for i, r in enumerate(rows, 1)]

    def follows(a, b, lo, hi, hours):
        return b[1] == a[2] and 0 < b[3] - a[3] <= hours and lo <= b[4] / a[4] <= hi

    second = {b[0] for a in data for b in data if follows(a, b, 0.92, 0.99, 24)}
    third = {b[0] for a in data if a[0] in second for b in data if follows(a, b, 0.92, 0.99, 24)}
    assert ids(t.layering_chains(df, cfg)) == third
    chains = [
        (a[0], b[0], c[0]) for a in data for b in data if follows(a, b, 0.92, 0.99, 24) for c in data if follows(b, c, 0.92, 0.99, 24)
    ]
    members = {r.transaction_id: (r.is_first, r.is_last) for r in t.layering_members(df, cfg).collect()}
    assert members == {i: (i in {c[0] for c in chains}, i in {c[2] for c in chains}) for c in chains for i in c}
    loops = {
        (a[0], b[0], c[0])
        for a in data for b in data if follows(a, b, 0.85, 1.0, 48) and b[2] not in (a[1], a[2]) and a[1] != a[2]
        for c in data if follows(b, c, 0.85, 1.0, 48) and c[2] == a[1]
    }
    assert {tuple(r.transactions) for r in t.circular_flows(df).collect()} == loops
    more = {
        (a[0], b[0], c[0], e[0])
        for a in data for b in data if follows(a, b, 0.85, 1.0, 48) and b[2] not in (a[1], a[2]) and a[1] != a[2]
        for c in data if follows(b, c, 0.85, 1.0, 48) and c[2] not in (a[1], b[1], c[1])
        for e in data if follows(c, e, 0.85, 1.0, 48) and e[2] == a[1]
    }
    assert {tuple(r.transactions) for r in t.circular_flows(df, up_to=4).collect()} == loops | more


@CONFIGS
def test_mule_pass_through(spark, cfg):
    df = edges(spark, ("x", "m", 0, 100), ("m", "y", 5, 50), ("m", "y", 24, 35), ("x", "k", 0, 100), ("k", "y", 25, 100), ("x", "j", 0, 100), ("j", "y", 0, 100))
    got = {r.transaction_id: r.amount_out for r in t.mule_pass_through(df, cfg).collect()}
    assert got == {"e1": 85.0}


@CONFIGS
def test_dormancy_velocity_and_balance(spark, cfg):
    schema = "transaction_id string, account_id string, timestamp timestamp, amount double, transaction_type string, balance_after double"
    rows = [("t1", "a", at(0), 10.0, "Credit", 110.0), ("t2", "a", at(24 * 90), 10.0, "Debit", 100.0), ("t3", "a", at(24 * 180.1), 10.0, "Debit", 95.0),
            ("t4", "a", at(24 * 181), 200.0, "Debit", -105.0)]
    df = spark.createDataFrame(rows, schema)
    assert ids(t.dormant_activation(df, cfg=cfg)) == {"t3"}
    got = {r.transaction_id: round(r.balance_gap, 2) for r in t.balance_reconciliation(df, cfg=cfg).collect()}
    assert got == {"t3": 5.0, "t4": 0.0}
    burst = spark.createDataFrame([(f"b{i}", "a", at(i / 10), 1.0, "Debit", 1.0) for i in range(9)], schema)
    flags = {r.transaction_id: (r.is_velocity, r.is_burst) for r in t.velocity_anomalies(burst, cfg=cfg).collect()}
    assert flags["b8"] == (True, True) and flags["b7"] == (False, True) and flags["b4"] == (False, False)


def test_simple_typologies(spark):
    txn = spark.createDataFrame(
        [("t1", "c1", "a1", at(0), 50_000.0, "Debit", "Branch", "m1", "US", "d1"), ("t2", "c1", "a1", at(1), 50_001.0, "Debit", "Online", "m2", "IR", "d1"),
         ("t3", "c2", "a2", at(2), 400_000.0, "Transfer", "Online", None, "IR", "d1"), ("t4", "c2", "a3", at(3), 400_000.0, "Debit", "Online", "m2", "IR", None)],
        "transaction_id string, customer_id string, account_id string, timestamp timestamp, amount double, transaction_type string, channel string, "
        "merchant_id string, counterparty_country string, device_id string",
    )
    country = spark.createDataFrame([("IR", "Black"), ("US", "Normal")], "country_code string, fatf_status string")
    merchants = spark.createDataFrame([("m1", "Freight/Shipping"), ("m2", "Hotels")], "merchant_id string, category string")
    assert ids(t.round_amounts(txn)) == {"t1"}
    assert ids(t.high_risk_geography(txn, country)) == {"t2", "t3", "t4"}
    assert ids(t.cross_border_unusual(txn)) == {"t2", "t3"}
    assert ids(t.trade_based(txn, merchants)) == {"t1"}
    assert ids(t.shell_pass_through(txn), "account_id") == {"a2"}
    assert ids(t.integration(txn)) == {"t4"}
    assert ids(t.integration(txn, layered=txn.where("transaction_id = 't3'"))) == {"t4"}
    assert ids(t.shared_devices(txn)) == {"t1", "t2", "t3"}
    members = spark.createDataFrame([("c2", "r1", "Mule")], "customer_id string, fraud_ring_id string, role string")
    assert ids(t.ring_members(txn, members)) == {"t3", "t4"}
    accounts = spark.createDataFrame([("A", "c1"), ("B", "c2"), ("C", "c3")], "account_id string, customer_id string")
    related = spark.createDataFrame([("c2", "c1")], "customer_id_1 string, customer_id_2 string")
    assert ids(t.relationship_based(edges(spark, ("A", "B", 0, 1), ("A", "C", 0, 1)), accounts, related)) == {"e1"}


def test_scenario_evaluation(spark):
    labelled = spark.createDataFrame([("t1", "Smurfing"), ("t2", "Smurfing"), ("t3", None)], "transaction_id string, aml_scenario_tag string")
    row = t.scenario_evaluation(labelled, {"Smurfing": labelled.where("transaction_id <> 't2'")}).first()
    assert (row.labelled, row.flagged, row.hits, row.precision, row.recall) == (2, 2, 1, 0.5, 0.5)


@pytest.mark.parametrize("ordered,lo,hi", [(True, 0.92, 0.99), (False, 0.9, 1.1)])
def test_flows_of_hot_accounts_and_copies(spark, ordered, lo, hi):
    """The sliced way, equal rows, amounts at the band's borders, edges from an account to itself: as all pairs say."""
    rng = random.Random(8)
    rows = [(f"n{rng.randint(0, 2)}", f"n{rng.randint(0, 2)}", rng.choice([0, 24, 48, rng.randint(0, 72)]), rng.choice([100, 99, 92, 91.08, 84.64, 98.01, 0, -5])) for _ in range(90)]
    df = edges(spark, *rows)
    data = [(f"e{i}", *r) for i, r in enumerate(rows, 1)]

    def follows(a, b, lo, hi, hours):
        gap = (b[3] - a[3]) if ordered else abs(b[3] - a[3])
        return b[1] == a[2] and a[0] != b[0] and (0 < gap or not ordered) and gap <= hours and min(a[4], b[4]) > 0 and lo <= b[4] / a[4] <= hi

    pairs = {(a[0], b[0]) for a in data for b in data if follows(a, b, lo, hi, 24)}
    chains = {(x, y, z) for x, y in pairs for w, z in pairs if w == y}
    if not ordered:
        members = {r.transaction_id: (r.is_first, r.is_last) for r in t.layering_members(df, EngineConfig(hop_hours=24, hop_ratio=(lo, hi)), False).collect()}
        first, last = {c[0] for c in chains}, {c[2] for c in chains}
        assert members == {i: (i in first, i in last) for c in chains for i in c} and members
        return
    cfg = EngineConfig(hop_hours=24, hop_ratio=(lo, hi), hot_key_rows=5, slice_rows=150)
    assert ids(t.layering_chains(df, cfg)) == {c[2] for c in chains} and chains
    loops = {
        (a[0], b[0], c[0])
        for a in data for b in data if a[1] != a[2] and follows(a, b, 0.85, 1.0, 48) and b[2] not in (a[1], a[2])
        for c in data if follows(b, c, 0.85, 1.0, 48) and c[2] == a[1]
    }
    got = [tuple(r.transactions) for r in t.circular_flows(df).collect()]
    assert set(got) == loops and len(got) == len(loops)


def test_hub_in_one_cell_is_linear(spark):
    """40,000 edges through one account within an hour and a band: 400 million pairs, which no join could go through here."""
    n = 40_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("transaction_id"), F.expr("IF(id % 2 = 0, 'hub', concat('a', id))").alias("src"),
        F.expr("IF(id % 2 = 0, concat('b', id), 'hub')").alias("dst"), F.timestamp_seconds(F.col("id") % 3600).alias("timestamp"), (100 - F.col("id") % 97 / 1000).alias("amount"),
    )
    cfg = EngineConfig(hop_hours=24, hop_ratio=(0.9, 1.1), layering_hops=2)
    found = t.layering_members(rows, cfg)
    # every payment to the hub is followed by a later one from it and the other way round, but for the first and last second
    assert found.count() == found.where("is_first <> is_last").count() == n - rows.where("dst = 'hub' AND timestamp = timestamp_seconds(3599)").count() - rows.where("src = 'hub' AND timestamp = timestamp_seconds(0)").count()


def test_a_sweep_shuffles_two_narrow_rows_an_edge(spark):
    """Ordinary accounts: one exchange by account below the spreading over cells, without the ids of transactions."""
    flows = t.Flows(edges(spark, ("a", "b", 0, 100), ("b", "c", 5, 95), ("c", "d", 9, 90)), t.FlowBand(0.92, 0.99, 72), EngineConfig())
    found = t._linked(flows.narrow, flows.narrow, flows.band, "e_dst", "e_src", True, flows.cfg, flows.heat)
    assert [r.e_src for r in found.orderBy("e_row").collect()] == ["a", "b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning(_account")
    assert "e_id" not in found.columns and not any("e_id" in line for line in plan.splitlines() if "Project" in line)


def test_a_hot_cell_of_a_hot_account_is_sliced(spark):
    """Accounts, cells and slices: the three ways of a sweep give the same edges."""
    rows = [("n", f"x{i}", i % 7, 100 - i % 5) for i in range(60)] + [(f"y{i}", "n", i % 9, 100 - i % 3) for i in range(60)] + [("q", "n", 900, 5), ("n", "r", 901, 4.8)]
    df = edges(spark, *rows)
    want = ids(t.layering_chains(df, EngineConfig(layering_hops=2)))
    assert len(want) > 1
    for hot, piece in ((100, 50), (20, 15)):
        assert ids(t.layering_chains(df, EngineConfig(layering_hops=2, hot_key_rows=hot, slice_rows=piece))) == want


def test_blocks_of_hot_accounts(spark):
    """Ordinary accounts, blocks of one and of several cells, and an account with a cell too full for a block: the same edges, in both directions."""
    rng = random.Random(3)
    rows = [(f"n{rng.randint(0, 2)}", f"n{rng.randint(0, 2)}", rng.randint(0, 400), rng.choice([100, 97, 93, 90, 40, 38, 9])) for _ in range(300)]
    rows += [("hub", f"x{i}", 5 + i % 3, 100 - i % 5) for i in range(40)] + [(f"y{i}", "hub", i % 6, 100 - i % 3) for i in range(40)]
    df = edges(spark, *rows)

    def members(cfg):
        return {r.transaction_id: (r.is_first, r.is_last) for r in t.layering_members(df, cfg).collect()}

    want = members(EngineConfig(hop_hours=24))
    assert len(want) > 50
    widths = []
    for hot, task in ((20, 25), (20, 60)):
        cfg = EngineConfig(hop_hours=24, hot_key_rows=hot, task_rows=task, slice_rows=15)
        assert members(cfg) == want
        flows = t.Flows(df, t.FlowBand(*cfg.hop_ratio, cfg.hop_hours), cfg)
        widths.append({r["_account"]: r["_width"] for r in flows.blocks.table.collect()})
        assert flows.blocks.full == ("hub" not in widths[-1])
    assert "hub" not in widths[0] and min(widths[0].values()) < max(widths[1].values())


def test_a_hot_account_is_dealt_in_narrow_rows(spark):
    """Rows shuffled for a hub: an edge that asks once, its points once more for each further block, not once for each cell and twice for points."""
    n = 4000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("transaction_id"), F.expr("IF(id % 2 = 0, 'hub', concat('a', id))").alias("src"),
        F.expr("IF(id % 2 = 0, concat('b', id), 'hub')").alias("dst"), F.timestamp_seconds(F.col("id") * 7200).alias("timestamp"), (100 + F.col("id") * 37 % 900).cast("double").alias("amount"),
    )
    cfg = EngineConfig(hot_key_rows=1000, task_rows=2000)
    flows = t.Flows(rows, t.FlowBand(0.92, 0.99, 24), cfg)
    hot = flows.narrow.where("e_dst = 'hub'").withColumn("_account", F.lit("hub")).unionByName(
        flows.narrow.where("e_src = 'hub'").select(F.lit("hub").alias("_account"), "e_us", "e_amount"), allowMissingColumns=True
    )
    dealt = t._dealt_by_block(hot, flows.band, True, flows.blocks)
    assert dealt.where("e_row IS NOT NULL").count() == n / 2
    assert dealt.count() < 0.7 * flows.band.spread(hot, True).count()


def test_cycles_named_late_keep_their_ids(spark):
    """Few edges are left for the search: ids come last, copies give cycles of their own, edges of one id or without one do not follow each other."""
    ring = [("A", "B", 0, 100), ("B", "C", 2, 100), ("C", "A", 4, 99), ("P", "Q", 0, 100), ("Q", "R", 1, 99), ("R", "P", 2, 98)]
    noise = [(f"s{i}", f"t{i}", i, 50) for i in range(60)]
    df = edges(spark, *ring, *noise)
    want = [["e1", "e2", "e3"], ["e4", "e5", "e6"]]
    assert sorted(r.transactions for r in t.circular_flows(df).collect()) == want
    assert sorted(r.transactions for r in t.circular_flows(df.unionByName(df.where("transaction_id = 'e2'"))).collect()) == [want[0], *want]
    named = df.withColumn("transaction_id", F.expr("CASE WHEN transaction_id = 'e2' THEN 'e1' WHEN transaction_id <> 'e5' THEN transaction_id END"))
    assert t.circular_flows(named).count() == 0


def test_both_directions_share_one_dealing(spark):
    flows = t.Flows(edges(spark, ("a", "b", 0, 100), ("b", "c", 5, 95), ("c", "d", 9, 90)), t.FlowBand(0.92, 0.99, 72), EngineConfig())
    first = flows.first()
    assert [r.e_src for r in first[True].orderBy("e_row").collect()] == ["a", "b"]
    assert [r.e_src for r in first[False].orderBy("e_row").collect()] == ["b", "c"]
