"""Queries over the driver tables, each next to the SQL that must agree with it."""

from importlib import import_module

MODULES = ("bands", "vector", "sampling", "aggregate", "join", "tiling", "source", "learn", "stream")


def load_all() -> None:
    for name in MODULES:
        import_module(f"checks.{name}_checks")
