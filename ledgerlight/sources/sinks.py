"""Table and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet")


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; choose one of {FORMATS}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_transactions(df: DataFrame, path: str) -> None:
    """Parquet by day, which makes date filters partition filters."""
    dated = df if "transaction_date" in df.columns else df.withColumn("transaction_date", F.to_date("timestamp"))
    save_table(dated, path, partition_by=["transaction_date"])


def save_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
