"""Named queries over the driver's tables, one module for each part of the inventory."""

import importlib

MODULES = ("finance", "scans", "joining", "windows", "sessions", "texts", "pricing", "streams", "composite", "books")


def load() -> None:
    """Import every module of queries; importing registers them, once."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
