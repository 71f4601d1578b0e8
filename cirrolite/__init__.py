"""Radar-event analytics as Spark DataFrame jobs."""
