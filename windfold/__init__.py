"""Windowed sensor-replay analytics expressed as Spark DataFrame jobs."""
