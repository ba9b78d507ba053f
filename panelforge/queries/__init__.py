"""The registered queries of the panel engine, by module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("features", "scoring", "regimes", "ledger", "execution", "search", "records", "ensemble", "texts", "horizons")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__name__}.{m}"), attribute)
    return out


def queries() -> dict[str, Callable]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
