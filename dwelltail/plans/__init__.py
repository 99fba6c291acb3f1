"""The registered queries."""

from dwelltail.plans import ground_truth, models  # noqa: F401
from dwelltail.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
