"""One immutable configuration object; the defaults are the values the detectors really use."""

from __future__ import annotations

from dataclasses import dataclass, field

# Engine weights, severity points, segment averages and vocabularies.
SEVERITY_POINTS = {"LOW": 25.0, "MEDIUM": 50.0, "HIGH": 80.0, "CRITICAL": 100.0}
FATF_WEIGHTS = {"Normal": 0.1, "Grey": 0.6, "Black": 1.0}
KYC_WEIGHTS = {"Low": 0.3, "Medium": 0.6, "High": 1.0}
KYC_ORDINAL = {"Low": 1, "Medium": 2, "High": 3}
SEGMENT_EXPECTED_AVERAGE = {
    "Retail": 8_000.0,
    "HNI": 60_000.0,
    "Corporate": 150_000.0,
    "Business": 90_000.0,
    "Student": 1_500.0,
    "Retiree": 5_000.0,
}
HIGH_RISK_COUNTRIES = ("IR", "KP", "MM", "SY", "YE")


@dataclass(frozen=True)
class FusionWeights:
    """Base weight of each detector family in the fused score."""

    rule: float = 0.30
    behaviour: float = 0.20
    statistical: float = 0.15
    ml: float = 0.15
    pattern: float = 0.20

    def __post_init__(self) -> None:
        total = self.rule + self.behaviour + self.statistical + self.ml + self.pattern
        if abs(total - 1.0) > 1e-9:
            raise ValueError(f"fusion weights must sum to 1, not {total}")


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds of all operators plus the knobs that keep plans safe on skewed data."""

    # --- rules -----------------------------------------------------------------
    z_score: float = 3.0
    velocity_hour: int = 5
    velocity_day: int = 15
    rule_deviation: float = 0.7
    sar_count: int = 0
    structuring_low: float = 8_000.0
    structuring_high: float = 10_000.0
    structuring_per_day: int = 3
    cash_ratio: float = 0.5
    # --- statistics --------------------------------------------------------------
    percentile: float = 0.95
    rolling_mean_ratio: float = 2.0
    rolling_std_multiple: float = 2.5
    frequency_multiple: float = 3.0
    hourly_multiple: float = 5.0
    gap_ratio: float = 0.1
    stat_deviation: float = 0.75
    composite_hits: int = 3
    iqr_multiple: float = 1.5
    # --- behaviour ---------------------------------------------------------------
    frequency_deviation: float = 0.5
    amount_deviation: float = 0.6
    # --- patterns ----------------------------------------------------------------
    burst_per_hour: int = 8
    burst_gap_hours: float = 0.1
    escalating_ratio: float = 3.0
    # --- multi-row typologies ------------------------------------------------------
    reporting_threshold: float = 1_000_000.0
    structuring_band: tuple[float, float] = (0.85, 0.98)
    structuring_count: int = 3
    structuring_days: int = 5
    smurfing_senders: int = 4
    smurfing_hours: int = 48
    layering_hops: int = 3
    hop_ratio: tuple[float, float] = (0.92, 0.99)
    hop_hours: int = 72
    mule_hours: int = 24
    mule_ratio: float = 0.85
    dormant_days: int = 90
    velocity_max_per_day: int = 8
    burst_max_per_hour: int = 5
    round_amounts: tuple[float, ...] = (10_000.0, 25_000.0, 50_000.0, 100_000.0, 200_000.0, 500_000.0)
    # --- profiles: type and channel vocabularies -------------------------------------
    cash_types: tuple[str, ...] = ("CASH_WITHDRAWAL",)
    deposit_types: tuple[str, ...] = ("DEPOSIT", "CASH_DEPOSIT")
    transfer_types: tuple[str, ...] = ("TRANSFER", "WIRE_TRANSFER")
    digital_channels: tuple[str, ...] = ("MOBILE", "WEB")
    home_country: str = "US"
    # --- anomaly model ---------------------------------------------------------------
    trees: int = 100
    tree_sample: int = 256
    contamination: float = 0.01
    seed: int = 42
    # --- cleaning and enrichment -------------------------------------------------------
    sparse_column_ratio: float = 0.5
    snapshot_date: str = "2024-01-01"
    # --- fusion and alerts ---------------------------------------------------------------
    weights: FusionWeights = field(default_factory=FusionWeights)
    alert_thresholds: tuple[float, float, float] = (90.0, 75.0, 50.0)
    max_alerts: int = 1_000
    # --- scale: hot groups and broadcast bounds --------------------------------------------
    hot_key_rows: int = 200_000
    slice_rows: int = 50_000
    task_rows: int = 50_000
    broadcast_rows: int = 200_000
