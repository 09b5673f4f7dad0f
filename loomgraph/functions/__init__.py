"""Columns: predicates, typed paths into attributes, and keys."""
