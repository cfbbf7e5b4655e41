"""Corpus operators for training-data pipelines; nothing else of the library imports this package."""
