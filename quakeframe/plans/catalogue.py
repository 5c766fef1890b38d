"""All queries of the seismic part, gathered from their modules."""

from quakeframe.plans import q_arrays, q_catalog, q_joins, q_metrics, q_streams  # noqa: F401
from quakeframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
