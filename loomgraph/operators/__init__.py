"""Operators over a graph's frames."""
