"""Imports every module that registers queries, so that the registry is complete."""

from __future__ import annotations

from rasterflow.plans import expansion_queries, image_queries, stored_queries  # noqa: F401  (they register)
from rasterflow.plans.queries import ORACLES, QUERIES


def all_queries() -> dict:
    return QUERIES


def all_oracles() -> dict:
    return ORACLES
