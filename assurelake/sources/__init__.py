"""Sources of the revenue-assurance engine."""
