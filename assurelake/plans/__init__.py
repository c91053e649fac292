"""Plans of the revenue-assurance engine."""
