"""Registered queries. Importing this package fills the registry."""

from webtables.catalog.base import ORACLE, QUERIES

_MODULES = ["html", "outcome", "params", "lookup", "jsonx", "shape", "sources", "listing", "streaming", "enrich", "wikitext", "tasks"]


def load():
    from importlib import import_module

    for m in _MODULES:
        import_module(f"webtables.catalog.{m}")
    return QUERIES, ORACLE
