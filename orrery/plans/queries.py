"""All queries over the world, by name."""

from orrery.plans import q_analytics, q_insights, q_joins, q_more, q_rules, q_snapshot, q_streams, q_views, q_world  # noqa: F401
from orrery.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
