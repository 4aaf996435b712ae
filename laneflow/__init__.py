"""Spatio-temporal analytics operators for road events and speed readings on Spark."""

__version__ = "0.1.0"
