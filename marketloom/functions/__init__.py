"""Column-level helpers: expressions and aggregate statistics."""
