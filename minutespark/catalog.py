"""All queries of the engine, and the same in SQL."""

from __future__ import annotations

from .queries import ORACLES, QUERIES, retrieval, texts, writes  # noqa: F401
