"""The twelve-table catalogue: explicit schemas, no inference, no eager reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlight import schemas
from ledgerlight.operators import quality


def read_csv(spark: SparkSession, path: str, table: str, raw: bool = False, keep_bad: bool = False) -> DataFrame:
    """CSV with a header. ``raw`` keeps text for the cleaning steps; a missing file is an error.

    A cell that does not fit its type is null; ``keep_bad`` adds the whole line as ``schemas.BAD_RECORD``.
    """
    schema = schemas.schema(table, raw)
    if keep_bad:
        schema = StructType([*schema.fields, StructField(schemas.BAD_RECORD, StringType())])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.BAD_RECORD)
        .csv(path)
    )


def load_catalogue(spark: SparkSession, folder: str, raw: bool = False, fmt: str = "csv", check: bool = True) -> dict[str, DataFrame]:
    """All tables by name; with ``check`` violations of the validation suites raise, unreadable cells among them."""
    if fmt == "csv":
        tables = {t: read_csv(spark, f"{folder}/{t}.csv", t, raw, keep_bad=check and not raw) for t in schemas.TABLES}
    else:
        tables = {t: spark.read.format(fmt).load(f"{folder}/{t}") for t in schemas.TABLES}
    if check:
        quality.require(quality.validate(tables))
    return {t: df.drop(schemas.BAD_RECORD) for t, df in tables.items()}


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(f"`{name}`")


def table_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns): one count per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        for n, df in tables.items()
    ]
    return quality.together(parts)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", True).json(path)
