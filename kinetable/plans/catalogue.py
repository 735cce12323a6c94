"""All queries of this package and their oracles."""

from __future__ import annotations

from . import corpus, custom, drawing, media, prompts, regions, scans, scoring, shapes, texts, trajectories, vectors  # noqa: F401  (they register queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
