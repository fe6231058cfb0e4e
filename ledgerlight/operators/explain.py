"""Narrative text and contributing factors from the findings on the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.fusion import COLUMNS, LABELS, with_families

ORDER = ("rule", "behaviour", "statistical", "ml", "pattern")


def factors() -> Column:
    """(type, name, score) of every finding; patterns show their confidence."""

    def shown(family: str) -> Column:
        field = {"pattern": "confidence"}.get(family, "score")
        return F.transform(
            F.col(COLUMNS[family]),
            lambda f: F.struct(F.lit(family).alias("type"), f["name"].alias("name"), f[field].alias("score")),
        )

    return F.concat(*[shown(f) for f in ORDER])


def indicators() -> Column:
    def names(family: str) -> Column:
        prefix = "ML Anomaly: " if family == "ml" else ""
        return F.transform(F.col(COLUMNS[family]), lambda f: F.concat(F.lit(prefix), f["name"]))

    return F.array_distinct(F.concat(*[names(f) for f in ORDER]))


def narrative() -> Column:
    """Four paragraphs: class, contributing engines, indicators, how far engines agree."""
    engines = F.array_compact(F.array(*[F.when(F.size(COLUMNS[f]) > 0, F.lit(LABELS[f])) for f in ORDER]))
    n = F.size(engines)
    grade = F.when(n >= 3, "High").when(n == 2, "Moderate").when(n == 1, "Lower").otherwise("Low")
    return F.concat_ws(
        "\n\n",
        F.concat(
            F.lit("Classified as "), F.col("risk_level"), F.lit(" RISK, score "),
            F.format_number("overall_risk_score", 2), F.lit(", confidence "), F.format_number("confidence_score", 2), F.lit("."),
        ),
        F.when(n > 0, F.concat(F.lit("Contributing engines: "), F.array_join(engines, ", "), F.lit(".")))
        .otherwise("No engine contributed."),
        F.when(F.size(indicators()) > 0, F.concat(F.lit("Indicators: "), F.array_join(indicators(), "; "), F.lit(".")))
        .otherwise("No indicators."),
        F.concat(grade, F.lit(" confidence: "), n, F.lit(" independent engine(s) agree.")),
    )


def explain(assessed: DataFrame) -> DataFrame:
    rows = with_families(assessed)
    return rows.withColumns(
        {
            "narrative": narrative(),
            "contributing_factors": factors(),
            "matched_patterns": F.transform("pattern_findings", lambda f: f["name"]),
        }
    )
