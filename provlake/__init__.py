"""Incremental, field-level data lineage as Spark DataFrame queries."""

import importlib

_WHERE = {
    "functions.filters": ("Filter", "FilterError", "parse"),
    "graph": ("FeatureGraph", "MissingFeature"),
    "model": ("ALL", "Definition", "FeatureDep", "FeatureKey", "FeatureSpec", "FieldDep", "FieldKey", "FieldSpec", "FieldsMapping", "Lineage", "feature"),
    "operators.increment": ("Increment",),
    "sources.store": ("ReadOnly", "Store"),
    "sources.tables": ("TableMissing",),
}
_FROM = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_FROM)


def __getattr__(name: str):
    """Names are loaded when first used, so that a task imports only what it runs."""
    if name not in _FROM:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_FROM[name]}"), name)
