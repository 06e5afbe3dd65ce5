"""Column functions: no joins, no shuffles, no Python workers."""
