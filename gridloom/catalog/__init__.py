"""All queries of the image and region operators."""

from __future__ import annotations

from gridloom.catalog import numeric, objects, shapes, shown, stencil, streams  # noqa: F401  (they register themselves)
from gridloom.catalog.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
