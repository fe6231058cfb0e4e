"""Validation as data: every check gives rows (table, check, column, violations, sample)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import schemas
from ledgerlight.session import materialise


class ValidationError(ValueError):
    """Raised by :func:`require` when a report holds violations."""


@dataclass(frozen=True)
class Check:
    """One check of a table: how many rows violate it, and a value that does."""

    check: str
    column: str
    violations: Column
    sample: Column | None = None


def report_rows(df: DataFrame, table: str, checks: Iterable[Check]) -> DataFrame:
    """A report row for each check, all from one aggregate over the table."""
    checks = list(checks)
    sums = [c.violations.cast("long").alias(f"_v{k}") for k, c in enumerate(checks)]
    samples = [(F.lit(None) if c.sample is None else c.sample).cast("string").alias(f"_s{k}") for k, c in enumerate(checks)]
    rows = F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(c.check).alias("check"), F.lit(c.column).alias("column"),
                 F.col(f"_v{k}").alias("violations"), F.col(f"_s{k}").alias("sample"))
        for k, c in enumerate(checks)
    ])
    return df.agg(*sums, *samples).select(F.inline(rows))


def report_row(df: DataFrame, table: str, check: str, column: str, violations: Column, sample: Column | None = None) -> DataFrame:
    """One report row from one aggregate."""
    return report_rows(df, table, [Check(check, column, violations, sample)])


def together(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no checks given")
    return out


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns that are absent; needs no job."""
    return [c for c in required if c not in df.columns]


def null_counts(df: DataFrame, columns: Iterable[str], table: str = "") -> DataFrame:
    """Null count of each column from one aggregate over the table."""
    columns = list(columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])
    return counted.select(F.inline(pairs)).select(
        F.lit(table).alias("table"), F.lit("not_null").alias("check"), "column", "violations",
        F.lit(None).cast("string").alias("sample"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def unique_check(df: DataFrame, key: str, table: str = "") -> DataFrame:
    """Rows beyond the first of each key."""
    return report_row(duplicate_keys(df, key), table, "unique", key, F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)), F.min(key))


def not_empty_check(df: DataFrame, table: str = "") -> DataFrame:
    """One violation for a table without rows; ``limit`` keeps it from reading more than one row."""
    return report_row(df.limit(1), table, "not_empty", "*", (F.count(F.lit(1)) == 0).cast("int"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, allow_nulls: bool = True) -> DataFrame:
    """Child rows without a parent (anti join); null keys count unless they are allowed."""
    rows = child.where(F.col(child_key).isNotNull()) if allow_nulls else child
    keys = parent.select(F.col(parent_key).alias("_parent_key"))
    return rows.join(keys, F.col(child_key) == F.col("_parent_key"), "left_anti")


#: Child table, child column, parent table, parent column, nulls allowed.
ForeignKey = tuple[str, str, str, str, bool]
EXAMPLES = 5


def key_report(tables: dict[str, DataFrame], primary: dict[str, str], foreign: Sequence[ForeignKey]) -> DataFrame:
    """Uniqueness of all primary keys and all foreign keys whose tables are present: one scan a table, one exchange.

    Every table's key columns are stacked as (domain, key, slot), a domain being a parent's key, slot 0 the parent itself and
    the others its children. One aggregate counts each slot of each key, combined before it is shuffled, so a key with many
    rows travels once; a key without parent rows is an orphan of every child that has it, and repeated parent rows are
    copies. Keys compare as text. A null key has no parent; where nulls are not allowed, its rows are orphans.
    """
    spark = next(iter(tables.values())).sparkSession
    present = [fk for fk in foreign if fk[0] in tables and fk[2] in tables]
    unique = [(t, k) for t, k in primary.items() if t in tables]
    domains = list(dict.fromkeys([*unique, *[(fk[2], fk[3]) for fk in present]]))
    children = [[fk for fk in present if fk[2:4] == d] for d in domains]
    if not domains:
        raise ValueError("no checks given")

    def item(column: str, domain: int, slot: int) -> Column:
        return F.struct(F.lit(domain).alias("domain"), F.col(column).cast("string").alias("key"), F.lit(slot).alias("slot"))

    columns: dict[str, list[Column]] = {}
    for d, (table, key) in enumerate(domains):
        columns.setdefault(table, []).append(item(key, d, 0))
        for s, fk in enumerate(children[d], 1):
            columns.setdefault(fk[0], []).append(item(fk[1], d, s))
    stacked = None
    for table, items in columns.items():
        part = tables[table].select(F.inline(F.array(*items)))
        stacked = part if stacked is None else stacked.unionByName(part)
    slots = 1 + max(map(len, children))
    counts = stacked.groupBy("domain", "key").agg(*[F.count_if(F.col("slot") == s).alias(f"_{s}") for s in range(slots)])
    null = F.col("key").isNull()
    saved = materialise(counts.where(null | (F.col("_0") != 1)))

    checks = [(f"unique {t}", t, "unique", k) for t, k in unique]
    found = []
    for d, domain in enumerate(domains):
        mine = F.col("domain") == d
        if domain in unique:
            found.append(F.when(mine & (F.col("_0") > 1), F.struct(F.lit(unique.index(domain)).alias("check"), (F.col("_0") - 1).alias("n"))))
        for s, (child, key, parent, parent_key, nulls) in enumerate(children[d], 1):
            lost = (F.lit(not nulls) & null) | (~null & (F.col("_0") == 0))
            found.append(F.when(mine & lost & (F.col(f"_{s}") > 0), F.struct(F.lit(len(checks)).alias("check"), F.col(f"_{s}").alias("n"))))
            checks.append((f"{child}.{key}", child, f"foreign_key->{parent}.{parent_key}" if parent else "foreign_key", key))
    long = saved.select("key", F.explode(F.array_compact(F.array(*found))).alias("f")).select("key", "f.check", "f.n")
    # numbers in their order, other keys as text
    first = Window.partitionBy("check").orderBy(F.expr("try_cast(key AS DECIMAL(38, 6))").asc_nulls_last(), "key")
    shown = long.where(~null).withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= EXAMPLES)
    example = F.when(F.col("check") < len(unique), F.min(F.when(F.col("_place") == 1, F.col("key")))).otherwise(F.array_join(F.sort_array(F.collect_list("key")), ","))
    sums = long.groupBy("check").agg(F.sum("n").alias("violations")).join(shown.groupBy("check").agg(example.alias("sample")), "check", "left")
    names = spark.createDataFrame([(i, *c[1:]) for i, c in enumerate(checks)], "_check int, table string, check string, column string")
    return names.join(sums.withColumnRenamed("check", "_check"), "_check", "left").select("table", "check", "column", F.coalesce("violations", F.lit(0)).alias("violations"), "sample")


def foreign_key_check(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, child_table: str = "",
    parent_table: str = "", allow_nulls: bool = True,
) -> DataFrame:
    """Orphan count and up to five orphan keys of one foreign key; see ``key_report`` for several."""
    report = key_report({"child": child, "parent": parent}, {}, [("child", child_key, "parent", parent_key, allow_nulls)])
    name = f"foreign_key->{parent_table}.{parent_key}" if parent_table else "foreign_key"
    return report.withColumns({"table": F.lit(child_table), "check": F.lit(name)})


def dtype_mismatches(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Warnings for columns whose Spark type differs; needs no job."""
    actual = dict(df.dtypes)
    return [f"{c}: expected {t}, found {actual[c]}" for c, t in expected.items() if c in actual and actual[c] != t]


def out_of_range(column: str, low=None, high=None) -> Check:
    """Rows outside [low, high] and the extreme value on the offending side."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < low)
    if high is not None:
        outside = outside | (F.col(column) > high)
    value = F.when(outside, F.col(column))
    return Check("range", column, F.count_if(outside), F.min(value) if low is not None else F.max(value))


def range_check(df: DataFrame, column: str, low=None, high=None, table: str = "") -> DataFrame:
    return report_rows(df, table, [out_of_range(column, low, high)])


def no_timestamp(column: str) -> Check:
    """Values that are present but no timestamps."""
    bad = F.col(column).isNotNull() & F.try_to_timestamp(F.col(column).cast("string")).isNull()
    return Check("timestamp", column, F.count_if(bad), F.min(F.when(bad, F.col(column).cast("string"))))


def timestamp_check(df: DataFrame, column: str, table: str = "") -> DataFrame:
    return report_rows(df, table, [no_timestamp(column)])


def unreadable(first: str) -> Check:
    """Rows of a text file with a cell that does not fit its column's type; the reader keeps such a line whole.

    ``first``: any column of the table, since Spark reads no text file for the kept line alone.
    """
    bad = F.col(schemas.BAD_RECORD).isNotNull()
    shown = F.concat(F.coalesce(F.col(first).cast("string"), F.lit("")), F.lit(": "), F.col(schemas.BAD_RECORD))
    return Check("readable", "*", F.count_if(bad), F.min(F.when(bad, shown)))


# --- suites ---------------------------------------------------------------------------------------------


def structure_suite(tables: dict[str, DataFrame]) -> DataFrame:
    """Core tables are not empty, all tables have their columns."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, "columns", ",".join(lost) or "*", len(lost), None)
        for name, df in tables.items()
        for lost in [missing_columns(df, schemas.TABLES[name])]
    ]
    columns = spark.createDataFrame(rows, "table string, check string, column string, violations long, sample string")
    core = [t for t in ("transaction", "customer", "account") if t in tables]
    return together([columns, *[not_empty_check(tables[t], t) for t in core]])


def type_suite(tables: dict[str, DataFrame]) -> DataFrame:
    """Nulls, unreadable lines, timestamps and ranges: one pass over each table that has such a check."""
    dated = {"transaction": ("timestamp",), "customer": ("dob", "onboarding_date"), "account": ("open_date",)}
    checks: dict[str, list[Check]] = {}
    for name, df in tables.items():
        own = [Check("not_null", c, F.count_if(F.col(c).isNull())) for c in schemas.NOT_NULL.get(name, ()) if c in df.columns]
        own += [no_timestamp(c) for c in dated.get(name, ()) if c in df.columns]
        own += [out_of_range(c, lo, hi) for t, c, lo, hi in schemas.RANGES if t == name and c in df.columns]
        own += [unreadable(df.columns[0])] if schemas.BAD_RECORD in df.columns else []
        if own:
            checks[name] = own
    return together(report_rows(tables[name], name, own) for name, own in checks.items())


def reference_suite(tables: dict[str, DataFrame]) -> DataFrame:
    """All primary keys and all foreign keys whose columns are present, the customers' own reference included."""
    has = lambda t, c: t in tables and c in tables[t].columns
    primary = {t: k for t, k in schemas.PRIMARY_KEYS.items() if has(t, k)}
    return key_report(tables, primary, [fk for fk in schemas.FOREIGN_KEYS if has(fk[0], fk[1]) and has(fk[2], fk[3])])


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """All suites in one report frame: a look at one row, a pass for values and a pass for keys of each table.

    A column that is missing is reported once, by the structure suite.
    """
    return together(suite(tables) for suite in (structure_suite, type_suite, reference_suite))


def require(report: DataFrame) -> None:
    """Raise when the report (one row per check) holds violations."""
    failed = report.where(F.col("violations") > 0).orderBy("table", "check", "column").collect()
    if failed:
        raise ValidationError("; ".join(f"{r.table}.{r.column} {r.check}: {r.violations}" for r in failed))


def acceptance_report(
    transactions: DataFrame, accounts: DataFrame, customers: DataFrame, min_per_scenario: int = 15
) -> DataFrame:
    """(check, passed, detail): references, unique ids, balances, labels and the verdict."""

    def keyed(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
        return foreign_key_check(df, key, parent, parent_key).select(
            F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"),
            F.concat(F.lit("orphans="), "violations").alias("detail"),
        )

    def unique(df: DataFrame, key: str) -> DataFrame:
        return unique_check(df, key).select(
            F.lit(f"unique {key}").alias("check"), (F.col("violations") == 0).alias("passed"),
            F.concat(F.lit("copies="), "violations").alias("detail"),
        )

    suspicious = F.col("flag_label") == "Suspicious"
    balance = transactions.agg(F.count_if(F.col("balance_after") < 0).alias("n")).select(
        F.lit("no negative balance").alias("check"), (F.col("n") == 0).alias("passed"),
        F.concat(F.lit("negative="), "n").alias("detail"),
    )
    scenarios = (
        transactions.where(suspicious & F.col("aml_scenario_tag").isNotNull()).groupBy("aml_scenario_tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("scenario "), "aml_scenario_tag").alias("check"),
            (F.col("n") >= min_per_scenario).alias("passed"), F.concat(F.lit("actual="), "n").alias("detail"),
        )
    )
    share = F.round(F.count_if(suspicious) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4)
    ratio = transactions.agg(share.alias("r")).select(
        F.lit("label ratio").alias("check"), F.lit(True).alias("passed"), F.concat(F.lit("suspicious="), "r").alias("detail")
    )
    lines = together(
        [
            keyed(transactions, "account_id", accounts, "account_id", "transaction.account_id -> account"),
            keyed(transactions, "customer_id", customers, "customer_id", "transaction.customer_id -> customer"),
            keyed(accounts, "customer_id", customers, "customer_id", "account.customer_id -> customer"),
            keyed(transactions, "counterparty_account_id", accounts, "account_id", "transaction.counterparty -> account"),
            unique(customers, "customer_id"), unique(accounts, "account_id"), unique(transactions, "transaction_id"),
            balance, scenarios, ratio,
        ]
    )
    verdict = lines.agg(F.every("passed").alias("passed")).select(
        F.lit("OVERALL").alias("check"), "passed", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("detail")
    )
    return lines.unionByName(verdict)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, rows, ratio) for all columns in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_rows").alias("rows")) for c in df.columns])
    return counts.select(F.inline(pairs)).withColumn("ratio", F.col("nulls") / F.nullif(F.col("rows"), F.lit(0)))
