"""Imports every module that registers queries."""

from weftline.llm import (  # noqa: F401
    chat,
    contamination,
    extract,
    infill,
    jaccard,
    kneser_ney,
    packing,
    passages,
    quality,
    repair,
    repeats,
    secrets,
    sharding,
)
from weftline.llm.registry import QUERIES

__all__ = ["QUERIES"]
