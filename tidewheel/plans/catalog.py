"""All queries of the library and their SQL."""

from tidewheel.plans import grid_queries, model_queries, panel_queries  # noqa: F401  (they register themselves)
from tidewheel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
