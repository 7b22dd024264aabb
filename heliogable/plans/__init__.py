"""Registered queries over the driver's tables, and their oracles."""

from __future__ import annotations

import importlib
import pkgutil


def _load():
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from heliogable.plans import base

    return base


def all_queries():
    return _load().QUERIES


def all_oracles():
    return _load().ORACLES
