"""Registered queries: the operators applied to the driver tables, with their oracles."""

from plurispark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
