"""Telemetry analytics as Spark DataFrame operations."""
