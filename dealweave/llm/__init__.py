"""Operators for preparing text and records for training. Nothing outside this package imports it."""
