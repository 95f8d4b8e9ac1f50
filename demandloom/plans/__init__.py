"""End-to-end plans and the registry of named queries."""

from __future__ import annotations

from importlib import import_module

CATALOGS = (
    "catalog_inputs", "catalog_quality", "catalog_panel", "catalog_forecast", "catalog_risk", "catalog_investigations",
)


def load_catalog() -> dict:
    """All registered queries by name."""
    for module in CATALOGS:
        import_module(f"{__name__}.{module}")
    return import_module(f"{__name__}.registry").REGISTRY
