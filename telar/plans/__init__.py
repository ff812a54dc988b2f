"""Plan-level helpers: lineage cuts and skew-safe joins."""
