"""Readers, writers and latest-value change logs."""
