"""Readers, text-dialect parsers and writers."""
