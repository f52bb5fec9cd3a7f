"""Corpus operators for training-data pipelines; nothing else in weftline imports this package."""
