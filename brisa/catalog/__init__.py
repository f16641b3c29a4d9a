"""All registered queries: each a Spark job over the given tables, most with equal SQL."""

from __future__ import annotations

from brisa.catalog.registry import ORACLES, QUERIES
from brisa.catalog import (  # noqa: F401  (importing registers)
    advisories,
    features,
    models,
    profiles,
    shapes,
    sources,
    streams,
)

__all__ = ["ORACLES", "QUERIES"]
