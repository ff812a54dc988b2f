"""Dataset operators: see the modules."""
