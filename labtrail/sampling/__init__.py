"""Stratified recall sampling."""
