"""Queries of this package, by name."""

from __future__ import annotations

from . import exact_dedup, licenses, mixing, packing, quality, scoring, simhash, token_files, topk, toxicity

MODULES = (exact_dedup, licenses, mixing, packing, quality, scoring, simhash, token_files, topk, toxicity)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
