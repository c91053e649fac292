"""Operators of the revenue-assurance engine."""
