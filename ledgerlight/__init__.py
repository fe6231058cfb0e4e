"""Spark-native financial-crime analytics: every public operator maps DataFrames to DataFrames."""

from ledgerlight.config import EngineConfig, FusionWeights
from ledgerlight.session import build_session

__all__ = ["EngineConfig", "FusionWeights", "build_session"]
