"""The validation suites and the cleaning run over tables with planted faults, next to plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight import schemas
from ledgerlight.operators import cleaning, quality
from ledgerlight.plans.registered import register
from ledgerlight.sources import driver_views as views

#: Bank tables out of the driver's, as text both for Spark and for SQL: names, sources, columns.
BANK = {
    "transaction": ("orders", {
        "transaction_id": "CASE WHEN o_orderkey % 113 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END", "account_id": "concat('A', CAST(o_custkey AS STRING))",
        "customer_id": "CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE concat('C', CAST(o_custkey AS STRING)) END",
        "timestamp": "CASE WHEN o_orderkey % 101 = 0 THEN concat('no date ', CAST(o_orderkey AS STRING)) ELSE '2024-03-01 10:00:00' END",
        "amount": "CASE WHEN o_orderkey % 97 = 0 THEN -1.5 WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_totalprice END",
    }),
    "customer": ("customer", {
        "customer_id": "concat('C', CAST(c_custkey AS STRING))", "full_name": "c_name", "dob": "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '31.12.1980' ELSE '1980-12-31' END",
        "age": "c_custkey % 90 - 2", "branch_id": "concat('B', CAST(c_nationkey AS STRING))", "beneficial_owner_id": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('C', CAST(c_custkey * 7 AS STRING)) END",
    }),
    "account": ("customer", {
        "account_id": "concat('A', CAST(c_custkey - c_custkey % 10 % 4 AS STRING))", "customer_id": "concat('C', CAST(c_custkey AS STRING))",
        "branch_id": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE concat('B', CAST(c_nationkey AS STRING)) END", "open_date": "'2020-01-01'",
    }),
    "branch": ("nation", {"branch_id": "concat('B', CAST(n_nationkey + n_nationkey % 5 AS STRING))"}),
}


def bank(spark, d) -> dict[str, DataFrame]:
    return {name: views.table(spark, d, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for name, (source, columns) in BANK.items()}


def bank_sql() -> str:
    # the quoted names are words of SQL
    cte = lambda name, source, columns: f"{name}_ AS MATERIALIZED (SELECT {', '.join(f'{e.replace('STRING', 'VARCHAR')} AS {chr(34)}{c}{chr(34)}' for c, e in columns.items())} FROM {source})"
    return ", ".join(cte(name, *spec) for name, spec in BANK.items())


def row(table: str, check: str, column: str, violations: str, sample: str = "NULL") -> str:
    return f"""SELECT '{table}' AS "table", '{check}' AS "check", '{column}' AS "column", CAST(({violations}) AS BIGINT) AS violations, CAST(({sample}) AS VARCHAR) AS sample"""


def suite_sql() -> str:
    rows = []
    for name, (_, columns) in BANK.items():
        lost = [c for c in schemas.TABLES[name] if c not in columns]
        rows.append(row(name, "columns", ",".join(lost), str(len(lost))))
        key = schemas.PRIMARY_KEYS[name]
        rows.append(row(name, "unique", key, f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {name}_ GROUP BY {key})", f"SELECT min({key}) FROM (SELECT {key} FROM {name}_ GROUP BY {key} HAVING count(*) > 1)"))
        for c in schemas.NOT_NULL.get(name, ()):
            rows.append(row(name, "not_null", c, f"SELECT count(*) FROM {name}_ WHERE {c} IS NULL"))
        if name in ("transaction", "customer", "account"):
            rows.append(row(name, "not_empty", "*", f"SELECT CAST(count(*) = 0 AS INT) FROM {name}_"))
    for name, c in (("transaction", "timestamp"), ("customer", "dob"), ("account", "open_date")):
        bad = f'FROM {name}_ WHERE "{c}" IS NOT NULL AND TRY_CAST("{c}" AS TIMESTAMP) IS NULL'
        rows.append(row(name, "timestamp", c, f"SELECT count(*) {bad}", f'SELECT min("{c}") {bad}'))
    for name, c, low, _ in schemas.RANGES:
        rows.append(row(name, "range", c, f"SELECT count(*) FROM {name}_ WHERE {c} < {low}", f"SELECT min({c}) FROM {name}_ WHERE {c} < {low}"))
    for child, c, parent, key, nulls in schemas.FOREIGN_KEYS:
        if child in BANK and parent in BANK and c in BANK[child][1] and key in BANK[parent][1]:
            lost = f"FROM {child}_ WHERE {c} NOT IN (SELECT {key} FROM {parent}_ WHERE {key} IS NOT NULL)" + ("" if nulls else f" OR {c} IS NULL")
            rows.append(row(child, f"foreign_key->{parent}.{key}", c, f"SELECT count(*) {lost}", f"SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT {c} AS k {lost.replace('WHERE ', 'WHERE (', 1)}) AND {c} IS NOT NULL ORDER BY 1 LIMIT 5)"))
    return f"WITH {bank_sql()} {' UNION ALL '.join(rows)}"


@register("validation_suites", suite_sql())
def validation_suites(spark, d):
    return quality.validate(bank(spark, d))


#: Customers as text with copies, empty rows, blanks and control characters, truths, numbers and dates in several spellings.
RAW = {
    "customer_id": "concat('C', CAST(c_custkey AS STRING))", "full_name": "concat('  ', replace(c_name, '#', '  \\t '), ' ')",
    "dob": "CASE WHEN c_custkey % 4 = 0 THEN '1980-02-03' WHEN c_custkey % 4 = 1 THEN '1991-12-31 23:59:58' WHEN c_custkey % 4 = 2 THEN '31/12/1990' END",
    "age": "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'unknown' ELSE concat(CAST(c_custkey % 71 AS STRING), '.7') END",
    "occupation": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END", "annual_income": "CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END",
    "is_pep": "CASE WHEN c_custkey % 6 = 0 THEN ' TRUE ' WHEN c_custkey % 6 = 1 THEN '1' WHEN c_custkey % 6 = 2 THEN NULL WHEN c_custkey % 6 = 3 THEN '0' ELSE 'yes' END",
}
TAB = "\\t"
RAW_SQL = f"""raw AS (SELECT {', '.join(f"{e.replace('STRING', 'VARCHAR').replace(TAB, "' || chr(9) || '")} AS {c}" for c, e in RAW.items())} FROM customer),
twice AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE customer_id LIKE '%3' UNION ALL SELECT {', '.join('NULL' for _ in RAW)} FROM range(3)),
known AS (SELECT DISTINCT * FROM twice), full_ AS (SELECT * FROM known WHERE {' OR '.join(f'{c} IS NOT NULL' for c in RAW)}),
typed AS (SELECT customer_id, regexp_replace(regexp_replace(regexp_replace(full_name, '^\\s+|\\s+$', '', 'g'), '[\\x00-\\x1F]', '', 'g'), '\\s+', ' ', 'g') AS full_name,
  TRY_CAST(dob AS TIMESTAMP) AS dob, CAST(trunc(TRY_CAST(age AS DOUBLE)) AS INT) AS age, occupation, TRY_CAST(annual_income AS DOUBLE) AS annual_income,
  coalesce(lower(trim(is_pep)) IN ('true', '1', '1.0'), false) AS is_pep FROM full_)"""


def raw_customers(spark, d) -> DataFrame:
    raw = views.table(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in RAW.items()])
    empty = spark.range(3).select(*[F.lit(None).cast("string").alias(c) for c in RAW])
    return raw.unionByName(raw.where("customer_id LIKE '%3'")).unionByName(empty)


@register("cleaned_customers", f"""WITH {RAW_SQL}, m AS (SELECT quantile_cont(age, 0.5) AS age, quantile_cont(annual_income, 0.5) AS annual_income FROM typed),
t AS (SELECT occupation AS top FROM typed WHERE occupation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT customer_id, full_name, strftime(dob, '%Y-%m-%d %H:%M:%S') AS dob, CAST(coalesce(typed.age, m.age) AS DOUBLE) AS age, coalesce(occupation, top) AS occupation,
  round(coalesce(typed.annual_income, m.annual_income), 4) AS annual_income, is_pep FROM typed, m, t""")
def cleaned_customers(spark, d):
    cleaned, _ = cleaning.clean_and_report(raw_customers(spark, d), "customer")
    filled = cleaning.impute(cleaned)
    return filled.select("customer_id", "full_name", F.date_format("dob", "yyyy-MM-dd HH:mm:ss").alias("dob"), F.col("age").cast("double").alias("age"), "occupation", F.round("annual_income", 4).alias("annual_income"), "is_pep")


@register("cleaning_observed", f"""WITH {RAW_SQL}, b AS (SELECT count(*) AS n, sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in RAW)}) AS nulls FROM twice),
a AS (SELECT count(*) AS n, sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in RAW)}) AS nulls FROM typed)
SELECT b.n AS rows_in, a.n AS rows_out, b.n - a.n AS rows_removed, b.n - (SELECT count(*) FROM known) AS duplicates_removed,
  CAST(b.nulls AS BIGINT) AS nulls_in, CAST(a.nulls AS BIGINT) AS nulls_out FROM a, b""")
def cleaning_observed(spark, d):
    """The report that the cleaning job itself has observed."""
    _, report = cleaning.clean_and_report(raw_customers(spark, d), "customer")
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{c} long" for c in report))
