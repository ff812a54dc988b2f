"""Operators and queries of sources: see the modules."""
