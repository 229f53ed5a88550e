"""Operators of a training-data pipeline over the document tables."""
