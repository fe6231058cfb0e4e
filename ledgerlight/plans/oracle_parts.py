"""SQL building blocks of the oracle: views, profiles, features, findings and fusion as CTE texts."""

from __future__ import annotations

from ledgerlight.config import EngineConfig

CFG = EngineConfig()


def time_parts(ts: str) -> str:
    return (
        f"CAST(hour({ts}) AS INT) AS hour_of_day, CAST(isodow({ts}) - 1 AS INT) AS day_of_week, "
        f"CAST(month({ts}) AS INT) AS transaction_month, isodow({ts}) >= 6 AS is_weekend, "
        f"CAST({ts} AS DATE) AS transaction_date, hour({ts}) BETWEEN 9 AND 17 AS is_business_hours"
    )


EV = f"""v AS (
  SELECT event_id AS transaction_id, user_id AS customer_id, ts, value AS amount, event_type AS transaction_type,
         event_type AS channel, nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS device_id, {time_parts('ts')}
  FROM events)"""
LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT))"
)
LINES = f"""v AS (
  SELECT {LINE_ID} AS transaction_id, o_custkey AS customer_id, l_shipdate AS ts, l_extendedprice AS amount,
         l_suppkey AS counterparty_account_id, na.n_name AS counterparty_country, nh.n_name AS location_country,
         l_partkey AS merchant_id, l_returnflag AS transaction_type, l_linestatus AS channel, {time_parts('l_shipdate')}
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation nh ON c_nationkey = nh.n_nationkey
  LEFT JOIN nation na ON s_nationkey = na.n_nationkey)"""
ORDERS = f"""v AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate AS ts, o_totalprice AS amount,
         o_orderstatus AS transaction_type, o_orderpriority AS channel, n_name AS location_country, {time_parts('o_orderdate')}
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
EDGES = f"""ed AS (
  SELECT {LINE_ID} AS transaction_id,
         CASE WHEN l_returnflag = 'R' THEN concat('S', l_suppkey) ELSE concat('C', o_custkey) END AS src,
         CASE WHEN l_returnflag = 'R' THEN concat('C', o_custkey) ELSE concat('S', l_suppkey) END AS dst,
         l_shipdate AS ts, l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def mode_cte(name: str, column: str, alias: str, source: str = "v") -> str:
    return f"""{name} AS (
  SELECT customer_id, min(x) AS {alias} FROM (
    SELECT customer_id, {column} AS x, count(*) AS n, max(count(*)) OVER (PARTITION BY customer_id) AS m
    FROM {source} WHERE {column} IS NOT NULL GROUP BY customer_id, {column}) WHERE n = m GROUP BY customer_id)"""


def profile(party: bool = False, device: bool = False, source: str = "v", name: str = "p") -> str:
    """CTEs ending in the profile table; type ratios are 0 because the types are not cash or transfer types."""
    b = "count(DISTINCT counterparty_account_id)" if party else "CAST(0 AS BIGINT)"
    c = "count(DISTINCT counterparty_country)" if party else "CAST(0 AS BIGINT)"
    d = "count(DISTINCT device_id)" if device else "CAST(0 AS BIGINT)"
    modes = [
        mode_cte(f"{name}_h", "hour_of_day", "preferred_hour", source),
        mode_cte(f"{name}_w", "day_of_week", "most_active_weekday", source),
        mode_cte(f"{name}_m", "transaction_month", "most_active_month", source),
        mode_cte(f"{name}_c", "channel", "most_common_channel", source),
        mode_cte(f"{name}_t", "transaction_type", "most_common_txn_type", source),
    ]
    return ",\n".join(modes) + f""",
{name}_g AS (
  SELECT customer_id, avg(amount) AS avg_amount, quantile_cont(amount, 0.5) AS median_amount, max(amount) AS max_amount,
         min(amount) AS min_amount, coalesce(stddev_samp(amount), 0) AS std_amount, count(amount) AS total_txns,
         avg(CAST(is_business_hours AS INT)) AS business_hours_ratio, avg(CAST(is_weekend AS INT)) AS weekend_ratio,
         greatest(count(DISTINCT transaction_date), 1) AS active_days,
         CAST(date_diff('day', min(transaction_date), max(transaction_date)) AS BIGINT) AS span_days,
         {b} AS unique_beneficiaries, {c} AS unique_countries, {d} AS unique_devices,
         count(DISTINCT channel) AS unique_channels
  FROM {source} GROUP BY customer_id),
{name} AS (
  SELECT *, total_txns / active_days AS avg_daily_txns, total_txns / greatest(active_days / 7, 1.0) AS avg_weekly_txns,
         total_txns / greatest(active_days / 30, 1.0) AS avg_monthly_txns,
         CASE WHEN total_txns > 1 THEN span_days / greatest(total_txns - 1, 1) ELSE 0 END AS avg_txn_gap_days
  FROM {name}_g JOIN {name}_h USING (customer_id) JOIN {name}_w USING (customer_id) JOIN {name}_m USING (customer_id)
  JOIN {name}_c USING (customer_id) JOIN {name}_t USING (customer_id))"""


def back(micros: int) -> str:
    return f"RANGE BETWEEN INTERVAL '{micros - 1} microseconds' PRECEDING AND CURRENT ROW"


HOUR, DAY, WEEK = 3_600_000_000, 86_400_000_000, 604_800_000_000


def features(party: bool = False, device: bool = False) -> str:
    """CTEs f0, f1, f over view v and profile p."""
    party0 = """,
         row_number() OVER (PARTITION BY customer_id, counterparty_account_id ORDER BY ts, transaction_id) AS beneficiary_frequency,
         count(*) OVER (PARTITION BY customer_id, counterparty_account_id) AS beneficiary_transaction_count,
         avg(amount) OVER (PARTITION BY customer_id, counterparty_account_id) AS beneficiary_amount_average,
         coalesce(stddev_samp(amount) OVER (PARTITION BY customer_id, counterparty_account_id), 0) AS beneficiary_amount_std,
         row_number() OVER (PARTITION BY customer_id, counterparty_country ORDER BY ts, transaction_id) AS country_frequency,
         coalesce(counterparty_country <> lag(counterparty_country) OVER o, false) AS geographic_change,
         coalesce(counterparty_country <> location_country, false) AS cross_border_transaction""" if party else """,
         1 AS beneficiary_frequency, 1 AS beneficiary_transaction_count, 1 AS country_frequency,
         false AS geographic_change, false AS cross_border_transaction"""
    device0 = f""",
         row_number() OVER (PARTITION BY customer_id, device_id ORDER BY ts, transaction_id) AS device_frequency,
         coalesce(device_id <> lag(device_id) OVER o, false) AS device_switch_flag,
         list_unique(list(device_id) OVER (PARTITION BY customer_id ORDER BY ts {back(30 * DAY)})) AS unique_devices_last_30_days""" if device else """,
         1 AS device_frequency, false AS device_switch_flag, 1 AS unique_devices_last_30_days"""
    new = (
        f"{'beneficiary_frequency = 1' if party else 'false'} AS new_beneficiary, "
        f"{'country_frequency = 1' if party else 'false'} AS new_country, "
        f"{'device_frequency = 1' if device else 'false'} AS new_device"
    )
    return f"""f0 AS (
  SELECT *, date_diff('microsecond', lag(ts) OVER o, ts) / 3600000000.0 AS gap0,
         (rank() OVER a + count(*) OVER a) / 2.0 / count(*) OVER (PARTITION BY customer_id) AS amount_percentile,
         count(*) OVER (PARTITION BY customer_id ORDER BY ts {back(HOUR)}) AS transactions_last_hour,
         count(*) OVER d AS transactions_last_day, sum(amount) OVER d AS amount_last_day,
         count(*) OVER w AS transactions_last_week, sum(amount) OVER w AS amount_last_week,
         avg(amount) OVER d AS rolling_average_amount, coalesce(stddev_samp(amount) OVER d, 0) AS rolling_std_amount,
         row_number() OVER (PARTITION BY customer_id, channel ORDER BY ts, transaction_id) AS channel_frequency{party0}{device0}
  FROM v
  WINDOW o AS (PARTITION BY customer_id ORDER BY ts, transaction_id), a AS (PARTITION BY customer_id ORDER BY amount),
         d AS (PARTITION BY customer_id ORDER BY ts {back(DAY)}), w AS (PARTITION BY customer_id ORDER BY ts {back(WEEK)})),
f1 AS (
  SELECT f0.*, coalesce(gap0, 0) AS gap, {new},
         avg(coalesce(gap0, 0)) OVER (PARTITION BY customer_id ORDER BY ts {back(WEEK)}) AS average_gap,
         p.* EXCLUDE (customer_id), amount - avg_amount AS amount_difference, amount / (avg_amount + 1e-5) AS amount_ratio,
         (amount - avg_amount) / (std_amount + 1e-5) AS z
  FROM f0 JOIN p USING (customer_id)),
f2 AS (
  SELECT *, z > 3 OR amount > 3 * avg_amount AS large, NOT is_business_hours AS outside_hours,
         hour_of_day <> preferred_hour AS off_hour, day_of_week <> most_active_weekday AS off_weekday,
         transaction_month <> most_active_month AS off_month, channel <> most_common_channel AS off_channel,
         beneficiary_transaction_count > 10 AS often,
         least(abs(z), 5) / 5 AS amount_dev, least(transactions_last_day / (avg_daily_txns + 1e-5), 5) / 5 AS freq_dev
  FROM f1),
f AS (
  SELECT *, least(1.0, 0.4 * amount_dev + 0.3 * freq_dev + 0.1 * CAST(outside_hours AS DOUBLE)
         + 0.1 * CAST(off_hour AS DOUBLE) + 0.1 * CAST(off_weekday AS DOUBLE)) AS deviation
  FROM f2)"""


# id, severity, score, predicate, deviation (or null for a fixed confidence), fixed confidence
RULES = [
    ("R001", "Large Transaction", "'HIGH'", "80", "large"),
    ("R002", "Large Z-Score", "'MEDIUM'", "60", "z > 3"),
    ("R003", "Rapid Transaction Velocity", "'HIGH'", "75", "transactions_last_hour >= 5 OR transactions_last_day >= 15"),
    ("R004", "Behaviour Deviation", "'MEDIUM'", "65", "deviation > 0.7"),
    ("R005", "Outside Business Hours", "'LOW'", "20", "outside_hours"),
    ("R006", "Outside Preferred Hour", "'LOW'", "20", "off_hour"),
    ("R007", "New Beneficiary", "'LOW'", "30", "new_beneficiary"),
    ("R008", "High Frequency Beneficiary", "'MEDIUM'", "40", "often"),
    ("R009", "New Device", "'MEDIUM'", "50", "new_device"),
    ("R010", "Device Switch", "'MEDIUM'", "45", "device_switch_flag"),
    ("R011", "New Country", "'HIGH'", "70", "new_country"),
    ("R012", "Cross Border Transaction", "'MEDIUM'", "55", "cross_border_transaction"),
    ("R017", "Structuring Indicator", "'CRITICAL'", "95", "amount >= 8000 AND amount < 10000 AND transactions_last_day >= 3"),
    ("R016", "Dormant Account Reactivation", "'HIGH'", "80", "avg_monthly_txns < 0.5 AND (transactions_last_day >= 3 OR z > 2)"),
    ("R019", "Channel Anomaly", "'LOW'", "25", "off_channel"),
]
STATS = [
    ("S001", "Amount Z-Score", "CASE WHEN abs(z) > 4.5 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN abs(z) > 4.5 THEN 75 ELSE 50 END", "abs(z) > 3", "z"),
    ("S002", "Amount Percentile", "'MEDIUM'", "60", "amount_percentile > 0.95", "amount_percentile - 0.95"),
    ("S003", "Rolling Mean Deviation", "'MEDIUM'", "65", "rolling_average_amount > 0 AND amount / rolling_average_amount > 2", "amount / rolling_average_amount - 1"),
    ("S004", "Rolling Standard Deviation", "'HIGH'", "70", "rolling_std_amount > 0 AND (amount - rolling_average_amount) / rolling_std_amount > 2.5", "(amount - rolling_average_amount) / nullif(rolling_std_amount, 0)"),
    ("S005", "Transaction Frequency Spike", "'HIGH'", "80", "transactions_last_day / avg_daily_txns > 3", "transactions_last_day / avg_daily_txns"),
    ("S006", "Velocity Spike", "'CRITICAL'", "90", "transactions_last_hour / (avg_daily_txns / 24.0) > 5 AND transactions_last_hour >= 3", "transactions_last_hour / (avg_daily_txns / 24.0)"),
    ("S007", "Time Gap Outlier", "'MEDIUM'", "60", "gap > 0 AND average_gap > 0 AND gap / average_gap < 0.1", "average_gap / nullif(gap, 0)"),
    ("S008", "Behaviour Deviation", "'HIGH'", "75", "deviation > 0.75", "deviation"),
    ("S009", "Historical Range Violation", "CASE WHEN max_amount > 0 AND amount > max_amount THEN 'HIGH' ELSE 'LOW' END", "CASE WHEN max_amount > 0 AND amount > max_amount THEN 85 ELSE 30 END", "(max_amount > 0 AND amount > max_amount) OR (min_amount > 0 AND amount < min_amount)", "CASE WHEN max_amount > 0 AND amount > max_amount THEN amount - max_amount ELSE min_amount - amount END"),
]
NARROW = "(unique_beneficiaries < 3 AND avg_monthly_txns > 10)"
BEHAVIOUR = [
    ("B001", "Preferred Hour Deviation", "'LOW'", "25", "off_hour", "least(abs(hour_of_day - preferred_hour), 24 - abs(hour_of_day - preferred_hour))"),
    ("B002", "Business Hour Deviation", "'MEDIUM'", "40", "business_hours_ratio > 0.9 AND outside_hours", "1"),
    ("B003", "Weekend Behaviour Change", "'MEDIUM'", "45", "off_weekday AND weekend_ratio < 0.05", "1"),
    ("B004", "Frequency Behaviour Change", "'HIGH'", "75", "freq_dev > 0.5", "freq_dev"),
    ("B005", "Amount Behaviour Change", "'HIGH'", "70", "amount_dev > 0.6", "amount_dev"),
    ("B006", "Beneficiary Behaviour Change", f"CASE WHEN {NARROW} THEN 'MEDIUM' ELSE 'LOW' END", f"CASE WHEN {NARROW} THEN 60 ELSE 30 END", "new_beneficiary", f"CASE WHEN {NARROW} THEN 1.0 ELSE 0.5 END"),
    ("B007", "Device Behaviour Change", "CASE WHEN device_switch_flag THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN device_switch_flag THEN 70 ELSE 50 END", "device_switch_flag OR new_device", "1"),
    ("B008", "Channel Behaviour Change", "'MEDIUM'", "50", "off_channel", "1"),
    ("B009", "Country Behaviour Change", "'HIGH'", "80", "new_country", "1"),
]
PATTERNS = [
    ("P001", "Structuring / Smurfing", "'CRITICAL'", "amount >= 8000 AND amount < 10000 AND transactions_last_day >= 3", "0.95"),
    ("P003", "Layering", "'CRITICAL'", "transactions_last_day > 5 AND unique_beneficiaries > 5", "0.90"),
    ("P004", "Circular Transactions", "'HIGH'", "often AND beneficiary_transaction_count > 10 AND gap < 1.0", "0.80"),
    ("P005", "Fan-Out", "'HIGH'", "transactions_last_hour >= 5 AND new_beneficiary", "0.85"),
    ("P006", "Fan-In", "'HIGH'", "transactions_last_day >= 15 AND amount_dev < 0.2", "0.75"),
    ("P007", "Dormant Account Reactivation", "'HIGH'", "avg_monthly_txns < 0.5 AND (transactions_last_day >= 2 OR z > 1.5)", "0.90"),
    ("P008", "Cross-Border Layering", "'CRITICAL'", "cross_border_transaction AND geographic_change AND transactions_last_day >= 3", "0.95"),
    ("P011", "Shared Device Pattern", "'MEDIUM'", "device_switch_flag AND unique_devices_last_30_days >= 3", "0.80"),
    ("P012", "Shared Beneficiary Pattern", "'HIGH'", "often AND beneficiary_transaction_count > 15", "0.85"),
    ("P013", "Burst Activity", "'CRITICAL'", "transactions_last_hour >= 8 AND gap < 0.1", "0.95"),
    ("P014", "Escalating Transaction Amounts", "'HIGH'", "amount_ratio > 3 AND amount_percentile > 0.95", "0.90"),
]


def trust(base: float, slope: float, deviation: str) -> str:
    return f"round(CASE WHEN {deviation} > 0 THEN least(1.0, {base} + {slope} * ({deviation})) ELSE 0.8 END, 2)"


def family(name: str, single: list[str], composite: tuple[str, str, float, str]) -> str:
    """Findings of one family plus its composite: (transaction_id, id, name, severity, score, confidence)."""
    code, title, score, confidence = composite
    union = "\n  UNION ALL ".join(single)
    return f"""{name}1 AS ({union}),
{name} AS (SELECT * FROM {name}1 UNION ALL
  SELECT transaction_id, '{code}', '{title}', 'CRITICAL', CAST({score} AS DOUBLE), {confidence}
  FROM {name}1 WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY transaction_id HAVING count(*) >= 3)"""


def one(code: str, title: str, severity: str, score: str, when: str, confidence: str) -> str:
    return (
        f"SELECT transaction_id, '{code}' AS id, '{title}' AS name, {severity} AS severity, "
        f"CAST({score} AS DOUBLE) AS score, CAST({confidence} AS DOUBLE) AS confidence FROM f WHERE {when}"
    )


def rules() -> str:
    return family("r", [one(*row, "0.8") for row in RULES], ("R020", "Multiple High Risk Signals", 100, "0.8"))


def statistics() -> str:
    rows = [one(i, n, sev, sc, when, trust(0.5, 0.05, dev)) for i, n, sev, sc, when, dev in STATS]
    return family("s", rows, ("S010", "Composite Statistical Outlier", 95, "round(least(1.0, 0.5 + 0.05 * count(*)), 2)"))


def behaviour() -> str:
    rows = [one(i, n, sev, sc, when, trust(0.7, 0.1, dev)) for i, n, sev, sc, when, dev in BEHAVIOUR]
    return family("b", rows, ("B010", "Composite Behaviour Anomaly", 95, "round(least(1.0, 0.7 + 0.1 * count(*)), 2)"))


def patterns() -> str:
    rows = [one(i, n, sev, "0", when, conf) for i, n, sev, when, conf in PATTERNS]
    return family("t", rows, ("P015", "Composite AML Pattern", 0, "1.0"))


POINTS = "CASE severity WHEN 'LOW' THEN 25 WHEN 'MEDIUM' THEN 50 WHEN 'HIGH' THEN 80 ELSE 100 END"


def fused(model: bool = False) -> str:
    """CTEs ending in ``fused``; with ``model`` the model's findings m are a fifth family (best confidence, weight 0.15)."""
    fifth = " UNION ALL SELECT transaction_id, id, name, severity, score, confidence, 'm' FROM m" if model else ""
    return f"""
sums AS (
  SELECT transaction_id,
         least(100.0, sum(CASE WHEN fam = 'r' THEN score ELSE 0 END)) AS rs, least(100.0, sum(CASE WHEN fam = 'b' THEN score ELSE 0 END)) AS bs,
         least(100.0, sum(CASE WHEN fam = 's' THEN score ELSE 0 END)) AS ss,
         least(100.0, sum(CASE WHEN fam = 't' THEN CAST({POINTS} AS DOUBLE) ELSE 0 END)) AS ps,
         coalesce(max(CASE WHEN fam = 'm' THEN confidence * 100 END), 0) AS ms, count(*) FILTER (fam = 'm') AS mn,
         count(*) FILTER (fam = 'r') AS rn, count(*) FILTER (fam = 'b') AS bn, count(*) FILTER (fam = 's') AS sn,
         count(*) FILTER (fam = 't') AS pn, avg(CASE WHEN fam IN ('t', 'm') THEN confidence * 100 END) AS pc
  FROM (SELECT *, 'r' AS fam FROM r UNION ALL SELECT *, 'b' FROM b UNION ALL SELECT *, 's' FROM s UNION ALL SELECT *, 't' FROM t{fifth})
  GROUP BY transaction_id),
shares AS (
  SELECT *, (CASE WHEN rn > 0 THEN 0.3 ELSE 0.0 END) + (CASE WHEN bn > 0 THEN 0.2 ELSE 0.0 END) + (CASE WHEN mn > 0 THEN 0.15 ELSE 0.0 END)
          + (CASE WHEN sn > 0 THEN 0.15 ELSE 0.0 END) + (CASE WHEN pn > 0 THEN 0.2 ELSE 0.0 END) AS share,
         CAST(rn > 0 AS INT) + CAST(bn > 0 AS INT) + CAST(sn > 0 AS INT) + CAST(pn > 0 AS INT) + CAST(mn > 0 AS INT) AS active
  FROM sums),
fused0 AS (
  SELECT *, round(least(100.0, rs * 0.3 / share + bs * 0.2 / share + ss * 0.15 / share + ps * 0.2 / share + ms * 0.15 / share), 9) AS overall,
         CASE WHEN pc IS NULL THEN least(100.0, 40 + 15 * active) ELSE least(100.0, 40 + 15 * active) * 0.6 + pc * 0.4 END AS conf
  FROM shares),
fused AS (
  SELECT transaction_id, customer_id, round(overall + 1e-9, 2) AS overall_risk_score, round(conf + 1e-9, 2) AS confidence_score,
         CASE WHEN overall <= 20 THEN 'LOW' WHEN overall <= 40 THEN 'MEDIUM' WHEN overall <= 60 THEN 'HIGH'
              WHEN overall <= 80 THEN 'VERY HIGH' ELSE 'CRITICAL' END AS risk_level,
         active AS active_engines, rn, bn, sn, pn, mn, rs, bs, ss, ps, ms
  FROM fused0 JOIN v USING (transaction_id))"""


FUSED = fused()


def events_features() -> str:
    return ",\n".join([EV, profile(device=True), features(device=True)])


def lines_features() -> str:
    return ",\n".join([LINES, profile(party=True), features(party=True)])


def events_fused() -> str:
    return ",\n".join([events_features(), rules(), statistics(), behaviour(), patterns(), FUSED])


# --- isolation forest -------------------------------------------------------------------------------------

#: The model's features, in its order, as they are called in the feature CTE.
MODEL_COLUMNS = (
    "z", "amount_ratio", "transactions_last_hour", "transactions_last_day", "rolling_average_amount", "rolling_std_amount",
    "deviation", "freq_dev", "gap", "beneficiary_frequency", "device_frequency", "channel_frequency", "country_frequency",
    "avg_amount", "max_amount", "min_amount",
)


def _units(column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    return f"CAST(greatest(-9e15, least(9e15, floor(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END * 10000 + 0.3717))) AS BIGINT)"


def _path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1.0) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n} END"


def _draw(first: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {CFG.seed}, tree, node)), {first}, 8) AS BIGINT)"


def _picked(rows: str, width: int) -> str:
    """Rows of the growing trees with the split of their node: the drawn one of the features that vary, and the drawn cut."""
    lows = ", ".join(f"min(x[{i}]) OVER n" for i in range(1, width + 1))
    highs = ", ".join(f"max(x[{i}]) OVER n" for i in range(1, width + 1))
    return f"""(SELECT *, lo[pick] + CAST((hi[pick] - lo[pick])::HUGEINT * {_draw(9)} // 4294967296 AS BIGINT) AS cut FROM (
      SELECT *, varied[1 + {_draw(1)} % len(varied)] AS pick FROM (
      SELECT *, list_filter(range(1, {width + 1}), lambda i: hi[i] > lo[i]) AS varied FROM (
      SELECT tree, node, depth, deepest, x, [{lows}] AS lo, [{highs}] AS hi FROM {rows} WHERE depth < deepest WINDOW n AS (PARTITION BY tree, node)))
      WHERE len(varied) > 0))"""


def forest(columns: tuple[str, ...] = MODEL_COLUMNS, source: str = "f") -> str:
    """CTEs ending in scored (transaction_id, score) and model_cut (cut); needs WITH RECURSIVE.

    The trees grow level by level from the samples, then every row goes down every tree.
    """
    trees, sample = CFG.trees, CFG.tree_sample
    return f"""x AS MATERIALIZED (SELECT transaction_id, CAST(transaction_id AS VARCHAR) AS id, [{', '.join(map(_units, columns))}] AS x FROM {source}),
size AS (SELECT count(*) AS rows, least({trees}, greatest(1, count(*) // {sample})) AS shared FROM x),
ordered AS (SELECT p, x, shared, (row_number() OVER (PARTITION BY p ORDER BY md5(concat_ws(':', {CFG.seed}, p, id)), id, x) - 1) // {sample} AS run
  FROM x, size, range(0, {trees}) t(p) WHERE p * shared < {trees}),
sampled AS MATERIALIZED (SELECT p * shared + run AS tree, x, ceil(log2(greatest(2, count(*) OVER (PARTITION BY p, run)))) AS deepest
  FROM ordered WHERE run < shared AND p * shared + run < {trees}),
grown AS (SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS depth, deepest, x FROM sampled UNION ALL
  SELECT tree, CASE WHEN x[pick] > cut THEN 2 * node + 1 ELSE 2 * node END, depth + 1, deepest, x FROM {_picked('grown', len(columns))}),
splits AS MATERIALIZED (SELECT DISTINCT tree, node, pick, cut FROM {_picked('grown', len(columns))}),
leaves AS MATERIALIZED (SELECT tree, node, any_value(depth) + {_path('count(*)')} AS path FROM grown ANTI JOIN splits USING (tree, node) GROUP BY tree, node),
going AS (SELECT id, x, tree, CAST(1 AS BIGINT) AS node FROM x, (SELECT DISTINCT tree FROM sampled) UNION ALL
  SELECT id, x, going.tree, CASE WHEN x[pick] > cut THEN 2 * going.node + 1 ELSE 2 * going.node END FROM going JOIN splits ON splits.tree = going.tree AND splits.node = going.node),
lengths AS (SELECT id, sum(path) AS total FROM going JOIN leaves ON leaves.tree = going.tree AND leaves.node = going.node GROUP BY id),
scored AS MATERIALIZED (SELECT transaction_id, round(pow(2, -total / {trees} / (SELECT CASE WHEN n > 1 THEN {_path('n')} ELSE 1.0 END FROM (SELECT least({sample}, rows) AS n FROM size))), 9) AS score
  FROM lengths JOIN x USING (id)),
model_cut AS (SELECT quantile_cont(score, {1.0 - CFG.contamination}) AS cut FROM scored),
m AS (SELECT transaction_id, 'ML-' || upper(substr(md5(CAST(transaction_id AS VARCHAR)), 1, 16)) AS id, 'IsolationForest_v1' AS name, 'HIGH' AS severity,
    round(score - cut, 9) AS score, round(least(1.0, greatest(0.0, 0.5 + 2 * round(score - cut, 9))), 2) AS confidence
  FROM scored, model_cut WHERE round(score - cut, 9) > 0)"""
