"""Revenue-assurance analytics on Spark."""
