"""Observations and spans from tables, files and generators."""
