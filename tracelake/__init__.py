"""Telemetry analytics as PySpark DataFrame operators."""
