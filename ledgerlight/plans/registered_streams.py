"""Replays: the events table as a stream, next to the batch SQL that it has to agree with.

The stream runs to its end; rows that the watermark has not passed by then are not complete, and the SQL leaves them out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators import profiles
from ledgerlight.plans import oracle_parts as O
from ledgerlight.plans.registered import rd, register, rounded
from ledgerlight.session import shared_folder
from ledgerlight.sources import driver_views as views
from ledgerlight.streaming import live

#: The watermark of the last batch, in whole milliseconds.
DUE = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)"


def arriving(spark: SparkSession, d: str) -> DataFrame:
    schema = views.table(spark, d, "events").schema
    # a pattern, since a stream takes a plain path for a folder and the table may be one file
    return views.as_transactions(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet"))


def drained(out: DataFrame) -> DataFrame:
    """Everything that a stream emits until its input ends, from a table in the shared folder."""
    folder = f"{shared_folder(out.sparkSession)}/replay-{uuid.uuid4().hex}"
    query = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


@register("stream_trailing_counts", f"""WITH {O.EV}
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, count(*) OVER (PARTITION BY customer_id ORDER BY ts {O.back(O.HOUR)}) AS transactions_last_hour,
  count(*) OVER d AS transactions_last_day, {rd('sum(amount) OVER d', 4, 'amount_last_day')}
FROM v WINDOW d AS (PARTITION BY customer_id ORDER BY ts {O.back(O.DAY)}) QUALIFY ts <= {DUE}""")
def stream_trailing_counts(spark, d):
    rows = drained(live.trailing_counts(arriving(spark, d)))
    return rounded(rows.drop("customer_id", "timestamp"), 4, "amount_last_day")


PRIORITY = "CASE WHEN amount >= 150 THEN 'P1' WHEN amount >= 60 THEN 'P2' ELSE 'P3' END"


@register("stream_alert_suppression", f"""WITH RECURSIVE {O.EV},
a AS (SELECT CAST(transaction_id AS VARCHAR) AS alert_id, customer_id, ts, {PRIORITY} AS priority,
    row_number() OVER (PARTITION BY customer_id ORDER BY ts, CAST(transaction_id AS VARCHAR)) AS n FROM v WHERE amount >= 30 AND ts <= {DUE.replace("FROM events", "FROM events WHERE value >= 30")}),
s AS (SELECT alert_id, customer_id, ts, priority, n, true AS sent, ts AS last, priority AS rank FROM a WHERE n = 1 UNION ALL
  SELECT a.alert_id, a.customer_id, a.ts, a.priority, a.n, (a.ts - s.last >= INTERVAL 24 HOUR OR a.priority < s.rank) AS sent,
    CASE WHEN a.ts - s.last >= INTERVAL 24 HOUR OR a.priority < s.rank THEN a.ts ELSE s.last END,
    CASE WHEN a.ts - s.last >= INTERVAL 24 HOUR OR a.priority < s.rank THEN a.priority ELSE s.rank END
  FROM s JOIN a ON a.customer_id = s.customer_id AND a.n = s.n + 1)
SELECT alert_id, customer_id, priority FROM s WHERE sent""")
def stream_alert_suppression(spark, d):
    rows = arriving(spark, d).where("amount >= 30").withColumns({"alert_id": F.col("transaction_id"), "priority": F.expr(PRIORITY)})
    return drained(live.suppress_repeats(rows)).drop("timestamp")


VERSIONS = ("2024-01-11", "2024-01-21")


def _stateless(table: str, rows: list[tuple]) -> str:
    return " UNION ALL ".join(f"SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, '{i}' AS id, CAST({score} AS DOUBLE) AS score FROM {table} WHERE coalesce({when}, false)" for i, score, when in rows)


STATELESS = [(i, sc, w) for i, _, _, sc, w in O.RULES if i in ("R001", "R002", "R005", "R006", "R019")]
STATELESS += [(i, sc, w) for i, _, _, sc, w, _ in O.STATS + O.BEHAVIOUR if i in ("S001", "S009", "B001", "B002", "B003", "B005", "B008")]


@register("stream_detectors", f"""WITH {O.EV}, v1 AS (SELECT * FROM v WHERE ts < '{VERSIONS[0]}'), v2 AS (SELECT * FROM v WHERE ts < '{VERSIONS[1]}'),
{O.profile(device=True, source='v1', name='pa')}, {O.profile(device=True, source='v2', name='pb')},
ps AS (SELECT 1 AS version, * FROM pa UNION ALL SELECT 2, * FROM pb),
g AS (SELECT v.*, ps.* EXCLUDE (customer_id, version), amount - avg_amount AS amount_difference, (amount - avg_amount) / (std_amount + 1e-5) AS z
  FROM (SELECT *, CASE WHEN ts >= '{VERSIONS[1]}' AND customer_id IN (SELECT customer_id FROM pb) THEN 2 WHEN ts >= '{VERSIONS[0]}' THEN 1 ELSE 0 END AS version FROM v) v
  LEFT JOIN ps ON ps.customer_id = v.customer_id AND ps.version = v.version),
f AS (SELECT *, z > 3 OR amount > 3 * avg_amount AS large, NOT is_business_hours AS outside_hours, hour_of_day <> preferred_hour AS off_hour,
  day_of_week <> most_active_weekday AS off_weekday, channel <> most_common_channel AS off_channel, coalesce(CASE WHEN z IS NOT NULL THEN least(abs(z), 5) / 5 END, 0) AS amount_dev FROM g)
{_stateless('f', STATELESS)}""")
def stream_detectors(spark, d):
    rows = views.txn_events(spark, d)
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    for at in VERSIONS:
        profiles.build_profiles(rows, as_of=at).withColumn("valid_from", F.lit(at).cast("timestamp")).write.parquet(f"{folder}/profiles/version={at}")
    live.score_stream(arriving(spark, d), lambda: spark.read.parquet(f"{folder}/profiles").drop("version"), live.batch_findings, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("transaction_id").cast("string").alias("transaction_id"), "id", "score")
