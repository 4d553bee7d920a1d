"""Registered queries; importing this package fills the registry."""

import importlib

from tickloom.catalog.base import REGISTRY, Query

for _m in ("bars", "features", "panel", "trading", "performance", "accounts", "news", "storage", "streams"):
    importlib.import_module(f"tickloom.catalog.{_m}")

__all__ = ["REGISTRY", "Query"]
