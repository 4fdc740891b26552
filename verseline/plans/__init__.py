"""Bindings of the operators to the given tables, and the registered queries."""

from verseline.plans import alignment, blocks, catalogue, editing, formats, live, signals, timeline  # noqa: F401
