"""Fixture tables, query registry and the comparison SQL."""

from stocktide.plans import q_audit, q_clean, q_core, q_decide, q_features, q_models, q_scans, q_series  # noqa: F401
from stocktide.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
