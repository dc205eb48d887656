"""Column functions: text, geometry, TeX."""
