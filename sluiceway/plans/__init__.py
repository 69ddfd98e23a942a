"""Whole dataflows and the registered queries with their SQL twins."""
