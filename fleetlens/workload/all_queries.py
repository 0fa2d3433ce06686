"""Imports every query module, which registers its queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["metrics", "timeseries", "configs", "fleet", "streams"]


def load() -> None:
    for name in MODULES:
        import_module(f"fleetlens.workload.{name}")
