"""Column-level helpers: composite keys, list expressions, ranking metrics."""
