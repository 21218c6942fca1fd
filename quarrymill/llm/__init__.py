"""Operators for large training-data pipelines; nothing else in quarrymill imports this package."""
