"""All registered queries; importing the family modules fills the registry."""

import importlib
import pkgutil

from boardlake.plans.registry import ORACLE, QUERIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["QUERIES", "ORACLE"]
