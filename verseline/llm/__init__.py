"""Operators for text corpora that train language models; nothing else in the library imports this package."""
