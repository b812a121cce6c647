"""Queries on the driver's tables and the SQL each must agree with."""

from checks import aggregates, metrics, models, rows  # noqa: F401
from checks.base import CHECKS

__all__ = ["CHECKS"]
