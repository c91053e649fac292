"""Streaming of the revenue-assurance engine."""
