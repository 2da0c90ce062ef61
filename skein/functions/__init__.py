"""Expressions as columns."""
