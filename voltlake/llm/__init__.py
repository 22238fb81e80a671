"""Operators for training-data pipelines over events, clusters and texts."""
