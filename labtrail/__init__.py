"""Longitudinal laboratory analytics expressed as Spark DataFrame operators."""
