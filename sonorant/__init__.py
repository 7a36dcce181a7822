"""Acoustic event analytics on Spark."""
