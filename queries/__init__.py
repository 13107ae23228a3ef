"""One registered query per operator, each next to the SQL that checks it."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every module of this folder, so that all queries are registered."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.registry")
