"""Relational, ordered and streaming analytics written as plain PySpark."""

from weftline.session import build_session, tune

__all__ = ["build_session", "tune"]
