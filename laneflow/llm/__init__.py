"""Operators for preparing text and vector training data."""
