"""Operators over DataFrames: lookups, graph steps, components, clusters, attributes."""
