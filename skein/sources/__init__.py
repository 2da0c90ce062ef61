"""Graphs, their tables and the places they come from."""
