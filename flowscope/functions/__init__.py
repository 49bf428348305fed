"""Column-level helpers: placement parameters and text rendering."""
