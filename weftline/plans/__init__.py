"""Registered queries over the input tables."""
