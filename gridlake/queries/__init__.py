"""All registered queries of the library's own operators."""

from . import files, filters, grids, lattice, merging, profiles, rasters, reading, service, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
