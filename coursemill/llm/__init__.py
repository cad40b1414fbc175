"""Operators for training-data pipelines (problems 1 to 8)."""
