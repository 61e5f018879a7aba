"""Queries of the library over the star-schema test tables."""

from importlib import import_module

MODULES = ("columns", "joins", "aggregates", "lifecycle", "states", "ledger", "sources", "gates", "shards")


def load():
    """The registry with every module's queries in it."""
    for name in MODULES:
        import_module(f"catalog.{name}")
    return import_module("catalog.registry")
