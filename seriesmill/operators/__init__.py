"""Aggregations and projections over observations, series and spans."""
