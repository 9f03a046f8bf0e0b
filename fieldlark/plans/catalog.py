"""All queries of the library, by import of the modules that register them."""

from __future__ import annotations

from . import crowns, library, linking, relational, routing, structural, surfaces, validation  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
