"""Column functions: no joins, no shuffles."""
