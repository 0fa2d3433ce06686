"""Column-level helpers (no shuffles, no Python UDFs)."""
