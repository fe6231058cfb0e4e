"""Cleaning and typing. Steps are DataFrame -> DataFrame; only the fills and the sparse-column step run jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampType

from ledgerlight import schemas
from ledgerlight.config import EngineConfig
from ledgerlight.functions.timeparts import with_time_parts
from ledgerlight.operators.ordered import quantiles_of_counts
from ledgerlight.operators.quality import null_profile
from ledgerlight.session import materialise


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact copies go; the aggregation combines copies before its shuffle."""
    return df.dropDuplicates()


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def clean_text(c: Column) -> Column:
    """Trim, strip control characters, collapse whitespace, in that order."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"[\x00-\x1F\x7F-\x9F]", ""), r"\s+", " ")


def clean_strings(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: clean_text(F.col(c)) for c in text}) if text else df


def sparse_columns(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> list[str]:
    """Columns with more nulls than the limit; one row per column comes to the driver."""
    rows = null_profile(df).where(F.col("ratio") > cfg.sparse_column_ratio).select("column").collect()
    return [r.column for r in rows]


def drop_sparse_columns(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Opt-in: removing columns changes the schema with the data."""
    return df.drop(*sparse_columns(df, cfg))


def fill_values(df: DataFrame, columns: list[str], cfg: EngineConfig = EngineConfig()) -> dict[str, object]:
    """Median of numbers (0 if all null), most frequent text (smallest on ties, else UNKNOWN), false.

    All columns are stacked as (column, value) and counted in one aggregate; the modes are an aggregate of those counts and
    the medians one running position over them, so no column has a job of its own and none is held in one task. One value
    per column comes to the driver.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in columns if isinstance(kinds[c], NumericType)]
    texts = [c for c in columns if isinstance(kinds[c], StringType)]
    fills: dict[str, object] = {c: 0.0 for c in numbers} | {c: "UNKNOWN" for c in texts} | {c: False for c in columns if isinstance(kinds[c], BooleanType)}
    if not numbers and not texts:
        return {c: fills[c] for c in columns if c in fills}
    none = {"number": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}

    def item(c: str) -> Column:
        own = none | ({"number": F.col(c).cast("double")} if c in numbers else {"text": F.col(c)})
        return F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in own.items()])

    stacked = df.select(F.inline(F.array(*map(item, numbers + texts)))).where(F.coalesce(F.col("number").cast("string"), "text").isNotNull())
    counts = materialise(stacked.groupBy("column", "number", "text").agg(F.count(F.lit(1)).alias("_n")))
    if texts:
        best = counts.where(F.col("text").isNotNull()).groupBy("column").agg(F.min(F.struct(-F.col("_n"), "text")).alias("best"))
        fills |= {r.column: r.best["text"] for r in best.collect()}
    if numbers:
        medians = quantiles_of_counts(counts.where(F.col("number").isNotNull()), ["column"], "number", {"median": 0.5}, cfg)
        fills |= {r.column: float(r.median) for r in medians.collect()}
    return {c: fills[c] for c in columns if c in fills}


def impute(df: DataFrame, columns: list[str] | None = None, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Fill nulls. By default identifiers, dates and columns without nulls are left alone.

    What comes before is worked out once for counting and filling: pass a saved frame (see ``session.materialise``).
    """
    if columns is None:
        nulls = {r.column for r in null_profile(df).where(F.col("nulls") > 0).select("column").collect()}
        columns = [
            f.name for f in df.schema.fields
            if f.name in nulls and not f.name.endswith("_id") and not isinstance(f.dataType, (DateType, TimestampType))
        ]
    fills = fill_values(df, columns, cfg)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast("double") if isinstance(v, float) else F.lit(v)) for c, v in fills.items()}
    ) if fills else df


def to_boolean(c: Column) -> Column:
    """True for true/1 in any case, otherwise false."""
    return F.when(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0"), True).otherwise(False)


def to_timestamp(c: Column) -> Column:
    """Parsed in the session zone (UTC); anything else is null."""
    return F.try_to_timestamp(c.cast("string"))


def normalise_types(df: DataFrame, table: str) -> DataFrame:
    """Coerce to the declared types; invalid numbers and dates become null, text keeps its nulls."""
    casts: dict[str, Column] = {}
    for column, kind in schemas.TABLES[table].items():
        if column not in df.columns:
            continue
        c = F.col(column)
        if kind == "bool":
            casts[column] = to_boolean(c)
        elif kind == "ts":
            casts[column] = to_timestamp(c)
        elif kind == "num":
            casts[column] = c.try_cast("double")
        elif kind == "int":
            casts[column] = c.try_cast("double").try_cast("int")
        else:
            casts[column] = c.cast("string")
    return df.withColumns(casts)


def clean_table(df: DataFrame, table: str) -> DataFrame:
    """Duplicates, empty rows, text, types; transactions also get their time parts."""
    return clean_distinct(drop_duplicate_rows(df), table)


def clean_distinct(df: DataFrame, table: str) -> DataFrame:
    """``clean_table`` on rows without copies."""
    out = df.transform(drop_empty_rows).transform(clean_strings)
    out = normalise_types(out, table)
    return with_time_parts(out) if table == "transaction" else out


def quality_report(before: DataFrame, after: DataFrame, table: str) -> DataFrame:
    """(table, rows_in, rows_out, rows_removed, duplicates_removed, nulls_in, nulls_out) from one pass each.

    Copies are counted as rows minus distinct rows.
    """

    def nulls(df: DataFrame) -> Column:
        return F.sum(sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0)))

    one = F.lit(1).alias("_one")
    left = before.agg(
        F.count(F.lit(1)).alias("rows_in"), F.countDistinct(F.struct(*before.columns)).alias("_distinct"),
        F.coalesce(nulls(before), F.lit(0)).alias("nulls_in"),
    ).select("*", one)
    right = after.agg(F.count(F.lit(1)).alias("rows_out"), F.coalesce(nulls(after), F.lit(0)).alias("nulls_out")).select("*", one)
    return left.join(F.broadcast(right), "_one").select(
        F.lit(table).alias("table"), "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("rows_removed"),
        (F.col("rows_in") - F.col("_distinct")).alias("duplicates_removed"), "nulls_in", "nulls_out",
    )


def clean_and_report(df: DataFrame, table: str) -> tuple[DataFrame, dict[str, int]]:
    """The cleaned table, saved, and its report, which the same job has observed on the way.

    The numbers are those of ``quality_report``. They are sums that tasks send with their results; where a lost executor makes
    Spark repeat tasks before a shuffle, rows may count twice, and ``quality_report`` gives the exact numbers again.
    """
    nulls = lambda columns: F.coalesce(F.sum(sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))), F.lit(0)).alias("nulls")
    rows = F.count(F.lit(1)).alias("rows")
    seen, distinct, left = Observation(), Observation(), Observation()
    known = df.observe(seen, rows, nulls(df.columns)).transform(drop_duplicate_rows).observe(distinct, rows)
    out = clean_distinct(known, table)
    saved = materialise(out.observe(left, rows, nulls(out.columns)))
    before, after = seen.get, left.get
    return saved, {
        "rows_in": before["rows"], "rows_out": after["rows"], "rows_removed": before["rows"] - after["rows"],
        "duplicates_removed": before["rows"] - distinct.get["rows"], "nulls_in": before["nulls"], "nulls_out": after["nulls"],
    }


def preprocess(tables: dict[str, DataFrame], fill: bool = True, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Clean and type the core tables, then enrich transactions; an empty result is an error."""
    from ledgerlight.operators.enrichment import enrich

    core = ("transaction", "customer", "account")
    # saved once: the look for rows, the fills and the join all read it
    cleaned = {n: materialise(clean_table(df, n)) if n in core else df for n, df in tables.items()}
    for name in core:
        if cleaned[name].isEmpty():
            raise ValueError(f"empty DataFrame for {name}")
    if fill:
        cleaned = {n: impute(df, cfg=cfg) if n in core else df for n, df in cleaned.items()}
    return enrich(cleaned["transaction"], cleaned["customer"], cleaned["account"], cleaned.get("country_risk"), cfg)
