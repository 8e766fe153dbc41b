"""Settings of all jobs, from keyword arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


def _env(name: str, default):
    def read():
        raw = os.environ.get(name)
        return default if raw is None or raw == "" else type(default)(raw)

    return field(default_factory=read)


@dataclass(frozen=True)
class Settings:
    """Defaults follow the service these jobs replace; every field may be given by keyword."""

    provider: str = _env("EMBEDDING_PROVIDER", "local")
    embedding_model: str = _env("EMBEDDING_MODEL", "digest")
    embed_dim: int = _env("EMBED_DIM", 1536)
    summarize_model: str = _env("SUMMARIZE_MODEL", "extractive")
    chunk_size: int = _env("CHUNK_SIZE_CHARS", 2000)
    chunk_overlap: int = _env("CHUNK_OVERLAP_CHARS", 200)
    max_concurrency: int = _env("MAX_CONCURRENCY", 2)
    retry_max: int = _env("RETRY_MAX", 3)
    index_name: str = _env("MEILI_INDEX", "meetings")
    jdbc_url: str = _env("DATABASE_URL", "")
    normalize_limit: int = 100
    embed_limit: int = 50
    summarize_limit: int = 20
    export_limit: int = 100
    keyword_limit: int = 20
    eval_top_k: int = 20

    def __post_init__(self):
        if self.provider not in ("local", "openai"):
            raise ValueError(f"unknown embedding provider: {self.provider}")
        for f in fields(self):
            if f.name in ("embed_dim", "chunk_size") and getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be positive")


def clamp_top_k(k: int | None) -> int:
    """None and 0 mean 5; the rest is held between 1 and 100."""
    return max(1, min(100, k or 5))
