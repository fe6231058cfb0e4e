"""Structured Streaming: sliding and trailing counts, detectors on profile snapshots, alert suppression.

Late rows: a row older than the watermark is dropped by Spark, which counts it in the progress
(numRowsDroppedByWatermark); state is bounded by the watermark. What needs the order of a customer's rows waits until the
watermark has passed them, so it does not depend on how rows were dealt into batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlight.config import EngineConfig
from ledgerlight.functions.timeparts import DAY, HOUR
from ledgerlight.operators import detectors
from ledgerlight.operators.features import PAIRS, SWITCHES, finish_amount, finish_behaviour, finish_history, finish_pairs, with_profile

#: Features that need earlier rows of the customer; a stateless pass over a batch leaves them null.
LOOK_BACK = {
    **{c: "double" for c in ("amount_percentile", "time_since_previous_transaction", "rolling_average_amount", "rolling_std_amount", "average_gap_between_transactions", "beneficiary_amount_average", "beneficiary_amount_std")},
    **{c: "long" for c in ("transactions_last_hour", "transactions_last_day", "beneficiary_transaction_count", "unique_devices_last_30_days", *(f for _, f in PAIRS.values()))},
    **{c: "boolean" for c in SWITCHES.values()},
}
#: What follows from those.
DERIVED = {"frequency_deviation_score", "behaviour_deviation_score", "beneficiary_is_high_frequency", *(n for n, _ in PAIRS.values())}


def transaction_stream(spark, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sliding_velocity(stream: DataFrame, length: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Count and sum per customer in sliding windows.

    Partial aggregation runs before the shuffle, so a busy customer arrives as one row per window.
    """
    return (
        stream.withWatermark("timestamp", late)
        .groupBy("customer_id", F.window("timestamp", length, slide))
        .agg(F.count("amount").alias("transactions"), F.sum("amount").alias("volume"))
        .select("customer_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "transactions", "volume")
    )


def score_against_profiles(stream: DataFrame, profiles: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Amount features and the amount flags of each arriving row, from a static profile snapshot."""
    joined = with_profile(stream, profiles)
    none = F.lit(None).cast("double")
    rows = finish_amount(joined.withColumns({c: none for c in ("_avg", "_median", "_std", "_max", "_min")}))
    return rows.withColumns(
        {
            "is_large": F.coalesce("large_transaction_flag", F.lit(False)),
            "is_outlier": F.coalesce(F.abs("amount_z_score") > cfg.z_score, F.lit(False)),
            "above_history": F.coalesce(F.col("amount") > F.col("historical_max_amount"), F.lit(False)),
        }
    )


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def _due(state: GroupState) -> int:
    """Microseconds up to which no row can arrive any more."""
    return state.getCurrentWatermarkMs() * 1000


Step = Callable[[GroupState, dict, int], tuple[pd.DataFrame | None, dict | None, int | None]]


def _in_order(stream: DataFrame, key: str, late: str, columns: dict[str, str], out: str, extra: str, start: tuple, step: Step) -> DataFrame:
    """Keep a key's rows (``columns``, with their types) until the watermark has passed them, then hand them to ``step`` in order.

    The state holds ``us`` (sorted times) and the columns beside it, and ``extra`` of the step's own, from ``start``. A step
    gets the held rows and the time up to which they are complete; it returns rows to emit, what to hold on and when to be
    called next without rows.
    """
    names = list(columns)
    state_ddl = ", ".join(["us array<long>", *[f"{c} array<{t}>" for c, t in columns.items()], extra])
    own = [x.split()[0] for x in extra.split(", ")]

    def work(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(["us", *names, *own], state.get if state.exists else ([], *([] for _ in names), *start)))
        parts = [] if state.hasTimedOut else [f for f in frames if len(f)]
        if parts:
            new = pd.concat(parts)
            us = np.concatenate([np.asarray(held["us"], np.int64), _micros(new["timestamp"])])
            rows = {c: [*held[c], *(None if pd.isna(v) else v for v in new[c])] for c in names}
            order = sorted(range(len(us)), key=lambda i: (us[i], *(str(rows[c][i]) for c in names[:1])))
            held |= {"us": [int(us[i]) for i in order]} | {c: [rows[c][i] for i in order] for c in names}
        found, held, again = step(group, held, _due(state))
        if held is None:
            state.remove()
        else:
            state.update(tuple(held[c] for c in ["us", *names, *own]))
            if again is not None:
                state.setTimeoutTimestamp(max(again // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if found is not None and len(found):
            yield found

    rows = stream.select(key, "timestamp", *[F.col(c).cast(t).alias(c) for c, t in columns.items()]).where(F.col(key).isNotNull())
    return rows.withWatermark("timestamp", late).groupBy(key).applyInPandasWithState(work, out, state_ddl, "append", GroupStateTimeout.EventTimeTimeout)


def trailing_counts(stream: DataFrame, late: str = "2 hours", key: str = "customer_id") -> DataFrame:
    """Transactions of the hour and the day, and the day's amount, up to every row, as ``velocity_features`` counts them.

    A customer's state is the times and amounts of the last day and of rows that the watermark has not passed yet; a row is
    emitted once, when it is complete.
    """
    kind = dict(stream.dtypes)[key]

    def step(group, held, due):
        us = np.asarray(held["us"], np.int64)
        amount = np.array([np.nan if a is None else a for a in held["amount"]], float)
        counted = np.array([a is not None for a in held["amount"]], bool)
        seen = np.concatenate([[0], np.cumsum(counted)])
        to = int(np.searchsorted(us, due, side="right"))
        first = int(np.searchsorted(us, held["done"], side="right"))
        found = None
        if to > first:
            at = us[first:to]
            upto = np.searchsorted(us, at, side="right")
            since = {h: np.searchsorted(us, at - h, side="right") for h in (HOUR, DAY)}
            sums = [float(np.sum(amount[a:b][counted[a:b]])) if seen[b] > seen[a] else None for a, b in zip(since[DAY], upto)]
            found = pd.DataFrame({
                "transaction_id": held["transaction_id"][first:to], key: [group[0]] * (to - first), "timestamp": pd.to_datetime(at, unit="us"),
                "transactions_last_hour": seen[upto] - seen[since[HOUR]], "transactions_last_day": seen[upto] - seen[since[DAY]], "amount_last_day": pd.Series(sums, dtype=object),
            })
        done = max(int(held["done"]), int(us[to - 1]) if to else held["done"])
        # later rows lie after what is complete and look back one day
        keep = int(np.searchsorted(us, min(max(done, due), us[to] if to < len(us) else 2**62) - DAY, side="right"))
        if keep == len(us):
            return found, None, None
        rest = {c: held[c][keep:] for c in ("us", "transaction_id", "amount")}
        again = rest["us"][0] + DAY if to >= len(us) else int(us[to])
        return found, rest | {"done": done}, int(again)

    out = f"transaction_id string, {key} {kind}, timestamp timestamp, transactions_last_hour long, transactions_last_day long, amount_last_day double"
    return _in_order(stream, key, late, {"transaction_id": "string", "amount": "double"}, out, "done long", (-(2**62),), step)


def suppress_repeats(alerts: DataFrame, hours: float = 24, key: str = "customer_id", late: str = "2 hours") -> DataFrame:
    """(alert_id, key, timestamp, priority) of the alerts that are sent.

    An alert is held back for ``hours`` after an alert *sent* for its key, unless its priority (P1 before P2) is higher than
    that one's; only sending starts the time anew. Alerts at one time are taken by id. The state is the last one sent and
    alerts that the watermark has not passed; it goes when its time is over.
    """
    kind, length = dict(alerts.dtypes)[key], int(hours * HOUR)

    def step(group, held, due):
        last, rank, sent = held["last"], held["rank"], []
        to = int(np.searchsorted(np.asarray(held["us"], np.int64), due, side="right"))
        for i in range(to):
            us, priority = held["us"][i], held["priority"][i]
            if us - last >= length or (priority is not None and (rank is None or priority < rank)):
                sent.append(i)
                last, rank = us, priority
        found = pd.DataFrame({
            "alert_id": [held["alert_id"][i] for i in sent], key: [group[0]] * len(sent),
            "timestamp": pd.to_datetime([held["us"][i] for i in sent], unit="us"), "priority": [held["priority"][i] for i in sent],
        })
        rest = {c: held[c][to:] for c in ("us", "alert_id", "priority")}
        if not rest["us"] and due - last >= length:
            return found, None, None
        return found, rest | {"last": int(last), "rank": rank}, int(rest["us"][0] if rest["us"] else last + length)

    out = f"alert_id string, {key} {kind}, timestamp timestamp, priority string"
    return _in_order(alerts, key, late, {"alert_id": "string", "priority": "string"}, out, "last long, rank string", (-(2**62), None), step)


def without_look_back(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> dict[str, tuple[list[detectors.Detector], float, float]]:
    """Per family the detectors that need the row and the profile only, with the family's confidence formula."""
    needs = re.compile(rf"\b({'|'.join({*LOOK_BACK, *DERIVED})})\b")
    families = {
        "rule_hits": (detectors.rules(cfg), 0.8, 0.0), "behaviour_findings": (detectors.behaviours(df, cfg), 0.7, 0.1),
        "statistical_findings": (detectors.statistics(cfg), 0.5, 0.05), "pattern_findings": (detectors.patterns(cfg), 0.8, 0.0),
    }
    alone = lambda d: not needs.search(" ".join(map(str, (d.when, d.severity, d.score, d.deviation))))
    return {c: (list(filter(alone, own)), base, slope) for c, (own, base, slope) in families.items()}


def batch_findings(batch: DataFrame, versions: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(transaction_id, id, severity, score, confidence) of every detector without look-back on the rows of a batch.

    ``versions`` are profiles with ``valid_from``; each row is held against the one valid at its time.
    """
    # one profile a customer and version: the version is part of the key while profiles are joined
    marks = versions.groupBy("customer_id").agg(F.sort_array(F.collect_set("valid_from"), False).alias("_marks"))
    dated = batch.join(marks, "customer_id", "left").withColumn("_from", F.get(F.filter("_marks", lambda m: m <= F.col("timestamp")), F.lit(0))).drop("_marks")
    version = lambda at: F.concat_ws("|", F.col("customer_id").cast("string"), F.unix_micros(at))
    keyed = dated.withColumns({"_owner": F.col("customer_id"), "customer_id": F.when(F.col("_from").isNotNull(), version(F.col("_from")))})
    rows = with_profile(keyed, versions.withColumn("customer_id", version(F.col("valid_from"))).drop("valid_from"))
    rows = rows.withColumn("customer_id", F.col("_owner")).drop("_owner", "_from")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in LOOK_BACK.items()} | {c: F.lit(None).cast("double") for c in ("_avg", "_median", "_std", "_max", "_min")} | {"_mode_channel": F.lit(None).cast("string")})
    rows = finish_history(finish_pairs(finish_behaviour(finish_amount(rows)), cfg))
    columns = []
    for column, (own, base, slope) in without_look_back(rows, cfg).items():
        rows = detectors.detect(rows, column, own, None, base, slope, 3)
        columns.append(F.transform(column, lambda f: f.dropFields("evidence", "reason", "deviation", "name")))
    found = rows.select("transaction_id", F.explode(F.flatten(F.array(*columns))).alias("f"))
    return found.select("transaction_id", "f.id", "f.severity", "f.score", "f.confidence")


def score_stream(stream: DataFrame, versions: Callable[[], DataFrame], detect: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that runs ``detect`` (rows, profile versions) on every batch and writes its result under ``path``.

    ``versions`` is called for each batch, so a new snapshot takes effect without a restart. A batch is written to a folder of
    its number and replaces what an interrupted run has left there: after a restart every batch is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        detect(batch, versions()).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
