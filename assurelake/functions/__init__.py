"""Functions of the revenue-assurance engine."""
