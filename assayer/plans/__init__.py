"""Reports composed from several operators."""
