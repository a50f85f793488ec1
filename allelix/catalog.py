"""All registered queries of the engine and their SQL, gathered from the plan modules."""

from __future__ import annotations

from .plans import core, further, kmers, models, more, panels, positions, tables  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
