"""Registered queries over the given tables, each with an equivalent SQL text where one exists."""

from importlib import import_module

MODULES = ("questions", "profiles", "cleaning", "drawing", "timelines", "judging", "records", "learning")


def load() -> None:
    """Import every module of queries once."""
    for name in MODULES:
        import_module(f"checks.{name}")
