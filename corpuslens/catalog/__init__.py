"""Registered queries over the given tables."""

from __future__ import annotations


def load():
    """(queries, oracles) of all catalog modules."""
    from corpuslens.catalog import (  # noqa: F401
        chatting,
        corpus,
        grids,
        mixed,
        quality,
        registry,
        search,
        tableqa,
        usage,
    )

    return registry.QUERIES, registry.ORACLES
