"""Whole decisions for tables of requests: resolving callers, matching heard names."""
