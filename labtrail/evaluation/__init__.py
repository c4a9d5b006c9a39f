"""Grouped metrics, bootstrap and model comparison."""
