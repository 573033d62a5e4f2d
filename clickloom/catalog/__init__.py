"""Registered queries: every operator run over the given tables, with its SQL counterpart."""

from __future__ import annotations

from clickloom.catalog.registry import ORACLES, QUERIES


def load() -> None:
    from clickloom.catalog import (  # noqa: F401
        aggregates, columns, evaluation, features, joins, models, scalars, sinks, sources, splits, streams, windows,
    )


__all__ = ["ORACLES", "QUERIES", "load"]
