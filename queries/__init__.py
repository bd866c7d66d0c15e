"""Queries over the driver's tables and their SQL counterparts."""

from importlib import import_module

MODULES = ["columns", "seal", "normalize", "checks", "report", "organize", "events"]


def load():
    """The registry with every query module imported."""
    for name in MODULES:
        import_module(f"queries.{name}")
    return import_module("queries.registry")
