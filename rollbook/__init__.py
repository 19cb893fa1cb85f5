"""Rollbook: licence-register analytics on Spark."""
