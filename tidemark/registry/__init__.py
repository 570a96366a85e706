"""Registered queries, one per operator of the inventory, with their SQL oracles."""

import importlib
import pkgutil

from tidemark.registry.base import ORACLES, QUERIES


def load():
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(sorted(QUERIES.items())), dict(sorted(ORACLES.items()))
