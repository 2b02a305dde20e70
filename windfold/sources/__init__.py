"""Strict readers, writers and the role views over the driver tables."""
