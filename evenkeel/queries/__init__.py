"""Demonstration queries over the given tables, one per operator, with SQL twins."""

import importlib
import pkgutil


def load():
    """Import every query module and return the registry."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return importlib.import_module(f"{__name__}.base")
