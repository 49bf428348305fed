"""Reports composed of several operators, and the query catalogue."""
