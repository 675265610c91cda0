"""Metric sets: what is recorded, and its export as one plan."""
