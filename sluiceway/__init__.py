"""Sensor and file dataflows as plain Spark DataFrame functions."""
