"""See the package docstring of bitgrove."""
