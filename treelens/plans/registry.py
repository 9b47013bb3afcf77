"""The registered queries and their oracle SQL."""

from treelens.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
