"""Registered queries: each pairs a DataFrame plan with an independent SQL text."""
