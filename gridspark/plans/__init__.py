"""Runnable queries over the driver tables, one per operator."""

import importlib

_MODULES = ["cells_q", "series_q", "spatial_q", "catalog_q", "index_q", "source_q"]


def load() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
