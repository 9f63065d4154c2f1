"""Registered queries: each operator bound to the driver's tables, with its SQL."""

import importlib
import pkgutil


def load():
    """Import every catalog module and return (queries, sql)."""
    from . import registry

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.SQL
