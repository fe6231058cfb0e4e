"""Fusion of the families' findings into one risk assessment per transaction, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.config import SEVERITY_POINTS, EngineConfig

COLUMNS = {
    "rule": "rule_hits",
    "behaviour": "behaviour_findings",
    "statistical": "statistical_findings",
    "ml": "ml_findings",
    "pattern": "pattern_findings",
}
LABELS = {"rule": "Rule", "behaviour": "Behaviour", "statistical": "Statistical", "ml": "ML", "pattern": "Pattern"}

FINDING = (
    "array<struct<id:string,name:string,severity:string,score:double,confidence:double,deviation:double,"
    "reason:string,evidence:map<string,string>>>"
)


def with_families(df: DataFrame) -> DataFrame:
    """Empty arrays for families that did not run."""
    for column in COLUMNS.values():
        empty = F.array().cast(FINDING)
        df = df.withColumn(column, F.coalesce(F.col(column), empty) if column in df.columns else empty)
    return df


def total(findings: str, value) -> Column:
    return F.aggregate(F.col(findings), F.lit(0.0), lambda acc, f: acc + value(f))


def severity_points(f: Column) -> Column:
    points = F.lit(0.0)
    for level, value in SEVERITY_POINTS.items():
        points = F.when(f["severity"] == level, value).otherwise(points)
    return points


def family_scores() -> dict[str, Column]:
    """Capped score sums; best confidence for the model; severity points for patterns."""
    cap = F.lit(100.0)
    best = F.array_max(F.transform(F.col("ml_findings"), lambda f: f["confidence"]))
    out = {f: F.least(cap, total(COLUMNS[f], lambda x: x["score"])) for f in ("rule", "behaviour", "statistical")}
    out["ml"] = F.coalesce(best * 100.0, F.lit(0.0))
    out["pattern"] = F.least(cap, total("pattern_findings", severity_points))
    return out


def half_up(c: Column, digits: int) -> Column:
    """Round half up; the small shift keeps binary noise from turning a half down."""
    return F.round(c + 1e-9, digits)


def risk_level(score: Column) -> Column:
    return (
        F.when(score <= 20.0, "LOW")
        .when(score <= 40.0, "MEDIUM")
        .when(score <= 60.0, "HIGH")
        .when(score <= 80.0, "VERY HIGH")
        .otherwise("CRITICAL")
    )


def severe_names(column: str) -> Column:
    severe = F.filter(F.col(column), lambda f: f["severity"].isin("HIGH", "CRITICAL"))
    return F.transform(severe, lambda f: f["name"])


def only_flagged(df: DataFrame) -> DataFrame:
    """Rows with a finding.

    A plain filter would be pushed below the projections and take a copy of every detector with it,
    so that all of them run twice; a column that depends on the partition stays where it is.
    """
    marked = df.withColumn("_flagged", F.when(F.col("active_engines") > 0, F.spark_partition_id()))
    return marked.where(F.col("_flagged").isNotNull()).drop("_flagged")


def fuse(df: DataFrame, cfg: EngineConfig = EngineConfig(), keep_all: bool = False) -> DataFrame:
    """Risk assessment columns; only rows with at least one finding unless ``keep_all``."""
    rows = with_families(df)
    weights = {f: getattr(cfg.weights, f) for f in COLUMNS}
    active = {f: F.size(c) > 0 for f, c in COLUMNS.items()}
    rows = rows.withColumns({f"_score_{f}": s for f, s in family_scores().items()})
    share = sum((F.when(active[f], w).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
    rows = rows.withColumns(
        {
            "_share": share,
            "active_engines": sum((active[f].cast("int") for f in COLUMNS), F.lit(0)),
            "_trusted": total("ml_findings", lambda f: f["confidence"] * 100.0)
            + total("pattern_findings", lambda f: f["confidence"] * 100.0),
            "_trusted_n": F.size("ml_findings") + F.size("pattern_findings"),
        }
    )
    if not keep_all:
        rows = only_flagged(rows)
    weight = {
        f: F.when(active[f] & (F.col("_share") > 0), w / F.col("_share")).otherwise(0.0) for f, w in weights.items()
    }
    overall = sum((F.col(f"_score_{f}") * w for f, w in weight.items()), F.lit(0.0))
    overall = F.least(F.lit(100.0), F.greatest(F.lit(0.0), overall))
    agreement = F.least(F.lit(100.0), 40.0 + 15.0 * F.col("active_engines"))
    blended = agreement * 0.6 + F.col("_trusted") / F.nullif(F.col("_trusted_n"), F.lit(0)) * 0.4
    confidence = F.when(F.col("active_engines") == 0, 100.0).otherwise(F.coalesce(blended, agreement))

    def named(values: dict[str, Column]) -> Column:
        return F.create_map(*[p for f, v in values.items() for p in (F.lit(LABELS[f]), v)])

    model = F.when(F.size("ml_findings") > 0, F.array(F.lit("ML Identified Anomaly"))).otherwise(
        F.array().cast("array<string>")
    )
    reasons = F.concat(
        severe_names("rule_hits"), severe_names("pattern_findings"), severe_names("behaviour_findings"),
        severe_names("statistical_findings"), model,
    )
    return rows.withColumns(
        {
            "_overall": overall,
            "confidence_score": half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), confidence)), 2),
            "engine_scores": named({f: F.round(f"_score_{f}", 2) for f in COLUMNS}),
            "engine_weights": named({f: F.round(w, 4) for f, w in weight.items()}),
            "risk_breakdown": named({f: F.format_string("%.1f%%", w * 100.0) for f, w in weight.items()}),
            "triggered_rules": F.transform("rule_hits", lambda f: f["name"]),
            "triggered_patterns": F.transform("pattern_findings", lambda f: f["name"]),
            "top_reasons": F.slice(F.array_distinct(reasons), 1, 5),
        }
    ).withColumns({"overall_risk_score": half_up(F.col("_overall"), 2), "risk_level": risk_level(F.round("_overall", 9))}).drop(
        "_overall", "_share", "_trusted", "_trusted_n", *[f"_score_{f}" for f in COLUMNS]
    )


def gather_findings(long: dict[str, DataFrame]) -> DataFrame:
    """Group long finding tables by transaction: the way in for findings stored as rows.

    A transaction has one finding per detector. Copies are combined by an aggregate first, so what is
    collected per transaction is never longer than the list of detectors.
    """
    parts = None
    for family, rows in long.items():
        finding = F.struct("id", "name", "severity", "score", "confidence", "deviation", "reason", "evidence")
        tagged = rows.select("transaction_id", "customer_id", F.lit(family).alias("family"), "id", finding.alias("finding"))
        parts = tagged if parts is None else parts.unionByName(tagged)
    rank = F.struct("finding.score", "finding.confidence", "finding.deviation")
    single = parts.groupBy("transaction_id", "family", "id").agg(
        F.max("customer_id").alias("customer_id"), F.max_by("finding", rank).alias("finding")
    )

    def by_id(a: Column, b: Column) -> Column:
        return F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)

    return single.groupBy("transaction_id").agg(
        F.max("customer_id").alias("customer_id"),
        *[
            F.array_sort(F.collect_list(F.when(F.col("family") == f, F.col("finding"))), by_id).alias(c)
            for f, c in COLUMNS.items()
        ],
    )


def fixed_weight_fusion(scores: DataFrame, weights: dict[str, float], thresholds=(90.0, 75.0, 50.0)) -> DataFrame:
    """The plain weighted sum of score columns: missing is 0, cap 100, four tiers."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()]
    fused = F.least(F.lit(100.0), sum(parts, F.lit(0.0)))
    critical, high, medium = thresholds
    level = F.when(fused >= critical, "CRITICAL").when(fused >= high, "HIGH").when(fused >= medium, "MEDIUM").otherwise("LOW")
    return scores.withColumns({"fused_risk_score": fused, "fused_risk_level": level})
