"""Time expressions shared by cleaning, profiles and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch; also accepts timestamps without a zone."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def with_time_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, day, weekday (Monday 0), month, year, weekend, date and business-hours columns."""
    col = F.col(ts)
    hour = F.hour(col)
    return df.withColumns(
        {
            "hour_of_day": hour,
            "day_of_month": F.dayofmonth(col),
            "day_of_week": F.weekday(col),
            "transaction_month": F.month(col),
            "transaction_year": F.year(col),
            "is_weekend": F.weekday(col) >= 5,
            "transaction_date": F.to_date(col),
            "is_business_hours": hour.between(9, 17),
        }
    )
