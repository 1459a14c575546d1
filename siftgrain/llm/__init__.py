"""Operators of a training-data pipeline; nothing else in siftgrain imports this package."""
