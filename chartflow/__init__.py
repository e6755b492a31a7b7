"""Spark operators for longitudinal, entity-and-time keyed event data."""
