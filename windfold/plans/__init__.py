"""Registered queries, one module per section of the inventory."""
