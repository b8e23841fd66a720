"""Predicate compiler, metrics and plan-level helpers."""
