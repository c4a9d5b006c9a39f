"""Readers, writers and the views derived from the driver tables."""
