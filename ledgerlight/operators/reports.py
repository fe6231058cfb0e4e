"""Dataset summaries, dashboard aggregates, serving filters, status and feedback logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import materialise
from ledgerlight.config import EngineConfig
from ledgerlight.operators.alerts import alert_order
from ledgerlight.operators.ordered import exact_quantiles
from ledgerlight.operators.quality import together
from ledgerlight.sources.catalogue import table_metadata

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
# Feedback kinds and execution states counted in the learning summary.
FEEDBACK_TYPES = ("TRUE_POSITIVE", "FALSE_POSITIVE", "TRUE_NEGATIVE", "FALSE_NEGATIVE", "INVESTIGATOR_NOTE")
EXECUTION_STATES = ("COMPLETED", "FAILED", "PARTIAL_SUCCESS", "CANCELLED")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return table_metadata(tables).select("table", "rows")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def amount_summary(df: DataFrame, column: str = "amount", cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum as one row."""
    basic = df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    ).withColumn("_one", F.lit(1))
    quartiles = exact_quantiles(df, [], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, cfg).withColumn("_one", F.lit(1))
    return basic.join(F.broadcast(quartiles), "_one", "left").drop("_one")


def kpi_summary(alerts: DataFrame) -> DataFrame:
    """Totals by state and the resolution rate in percent."""
    total, closed = F.count(F.lit(1)), F.count_if(F.col("status") == "CLOSED")
    return alerts.agg(
        total.alias("total_alerts"),
        F.count_if(F.col("priority") == "P1_CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("status") == "OPEN").alias("open_alerts"),
        closed.alias("closed_alerts"),
        F.round(F.coalesce(closed * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)), 1).alias("resolution_rate"),
    )


def risk_distribution(alerts: DataFrame) -> DataFrame:
    """High, Medium and Low bands of the risk level."""
    level = F.col("risk_level")
    band = F.when(level.isin("CRITICAL", "VERY HIGH", "HIGH"), "High").when(level == "MEDIUM", "Medium").otherwise("Low")
    return alerts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("alerts"))


def weekday_trend(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows per weekday."""
    day = F.weekday(ts)
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return df.where(F.col(ts).isNotNull()).groupBy(day.alias("day_index")).agg(F.count(F.lit(1)).alias("rows")).select(
        "day_index", F.get(names, F.col("day_index")).alias("weekday"), "rows"
    )


def recent_activity(df: DataFrame, n: int = 5, ts: str = "timestamp", key: str = "transaction_id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(key).asc()).limit(n)


def search(df: DataFrame, text: str | None = None, columns: tuple[str, ...] = ("alert_id", "customer_id"), **equal: str) -> DataFrame:
    """Case-insensitive substring search over columns and equality filters; empty filters match all."""
    if text:
        hit: Column = F.lit(False)
        for c in columns:
            hit = hit | F.lower(F.col(c).cast("string")).contains(text.lower())
        df = df.where(F.coalesce(hit, F.lit(False)))
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def alert_query(alerts: DataFrame, min_priority: str = "P4_LOW", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Alerts at least as urgent as ``min_priority``; one page of them if ``limit`` is given."""
    rows = alerts.where(F.col("priority") <= min_priority).orderBy(*alert_order())
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def latest_status(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with the newest status of the append-only event table (alert_id, status, at)."""
    newest = events.groupBy("alert_id").agg(F.max_by("status", F.struct("at", "status")).alias("_status"))
    return alerts.join(newest, "alert_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def feedback_for(feedback: DataFrame, investigation_id: str) -> DataFrame:
    return feedback.where(F.col("investigation_id") == investigation_id)


def record_executions(log: DataFrame, new: DataFrame) -> DataFrame:
    """New executions to append; a negative duration or a known or repeated id is an error."""
    if not new.where(F.col("duration_seconds") < 0).isEmpty():
        raise ValueError("duration must not be negative")
    ids = new.groupBy("execution_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where(F.col("n") > 1).isEmpty() or not ids.join(log, "execution_id", "left_semi").isEmpty():
        raise ValueError("duplicate execution id")
    return new


def with_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each execution with its newest feedback."""
    newest = feedback.groupBy("execution_id").agg(
        F.max_by(F.struct("feedback_type", "investigator_notes"), F.struct("at", "feedback_type")).alias("_f")
    )
    return log.join(newest, "execution_id", "left").select(
        *log.columns, F.col("_f.feedback_type").alias("feedback_type"), F.col("_f.investigator_notes").alias("investigator_notes")
    )


def learning_summary(log: DataFrame, feedback_types: tuple[str, ...] = FEEDBACK_TYPES) -> DataFrame:
    """Counts by status, feedback counts with zeros, notes and mean duration in one pass."""
    status = [F.count_if(F.col("status") == s).alias(f"{s.lower()}_executions") for s in EXECUTION_STATES]
    feedback = [F.count_if(F.col("feedback_type") == t).alias(f"feedback_{t.lower()}") for t in feedback_types]
    noted = F.count_if(F.length(F.trim("investigator_notes")) > 0)
    return log.agg(
        F.count(F.lit(1)).alias("total_executions"), *status, *feedback, noted.alias("notes"),
        F.round(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)), 4).alias("average_duration"),
    )


def session_history(log: DataFrame, session_id: str) -> DataFrame:
    return log.where(F.col("session_id") == session_id)


#: Features of a customer's last transaction in the risk profile.
SHOWN_FEATURES = ("amount_z_score", "transactions_last_hour", "transactions_last_day", "behaviour_deviation_score")


def customer_risk(alerts: DataFrame, profiles: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Alert count, top score and worst level per customer, with the profile and the last features when given.

    ``features`` are feature rows of transactions; the last one of a customer (by time, then id) is shown, found by an
    aggregate that keeps one row a customer.
    """
    rank = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "VERY HIGH": 3, "CRITICAL": 4}
    order = F.lit(-1)
    for level, value in rank.items():
        order = F.when(F.col("risk_level") == level, value).otherwise(order)
    out = alerts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("fused_risk_score").alias("top_score"),
        F.max_by("risk_level", order).alias("worst_level"),
    )
    if profiles is not None:
        out = profiles.select("customer_id", "confidence_score", "summary").join(out, "customer_id", "left").withColumns(
            {"alerts": F.coalesce("alerts", F.lit(0)), "worst_level": F.coalesce("worst_level", F.lit("LOW"))}
        )
    if features is not None:
        last = features.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
            F.max_by(F.struct(*SHOWN_FEATURES), F.struct("timestamp", "transaction_id")).alias("features")
        )
        out = out.join(last, "customer_id", "left")
    return out


def run_report(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """(metric, value): transactions processed and alerts by priority; both alert numbers come from one grouped count, saved (a row a priority)."""
    counts = materialise(alerts.groupBy("priority").agg(F.count(F.lit(1)).alias("value")))
    return together(
        [
            transactions.agg(F.count(F.lit(1)).alias("value")).select(F.lit("transactions_processed").alias("metric"), "value"),
            counts.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(F.lit("alerts").alias("metric"), "value"),
            counts.select(F.concat(F.lit("alerts_"), "priority").alias("metric"), "value"),
        ]
    )


def filter_alerts(
    alerts: DataFrame, amount_above: float | None = None, amount_below: float | None = None, start: str | None = None,
    end: str | None = None, countries: list[str] | None = None, level: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Filters an analyst's question names; ``limit`` is the question's own top-n."""
    rows = alerts
    if amount_above is not None:
        rows = rows.where(F.col("amount") >= amount_above)
    if amount_below is not None:
        rows = rows.where(F.col("amount") <= amount_below)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("timestamp") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if countries:
        rows = rows.where(F.col("counterparty_country").isin(*countries))
    if level is not None:
        rows = rows.where(F.upper("risk_level") == level.upper())
    return rows.orderBy(*alert_order()).limit(limit) if limit else rows
