"""Imports every module that registers queries."""

from weftline.plans import aggregates, joins, relational, reshape, sources, streams, udfs, windows  # noqa: F401
from weftline.plans.registry import QUERIES

__all__ = ["QUERIES"]
