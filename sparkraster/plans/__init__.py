"""Registered queries over the test tables, each with its SQL counterpart where one exists."""
from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
