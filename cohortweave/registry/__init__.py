"""Operators applied to the driver tables, each with the SQL that checks it."""

from cohortweave.registry import catalog, hierarchy, io, patients, pixels, reports, samples, series  # noqa: F401
from cohortweave.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
