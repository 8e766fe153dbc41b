"""Embedding providers and the UDFs built on them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vector import l2_normalize


#: The name of no model: digests.
DIGEST = "digest"


class Provider(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def with_retry(call: Callable[[], object], attempts: int, sleep: Callable[[float], None] = time.sleep):
    """Call up to ``attempts`` times, waiting 1, 2, 4 ... at most 60 seconds between."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            sleep(min(60, 2 ** (n - 1)))
    raise ValueError("attempts must be positive")


class RemoteProvider:
    """Batches of 100 texts through an injected client (``client(texts) -> vectors``)."""

    def __init__(self, client: Callable[[Sequence[str]], list[list[float]]], batch: int = 100, attempts: int = 6):
        self.client, self.batch, self.attempts = client, batch, attempts

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            out += with_retry(lambda part=list(texts[at : at + self.batch]): self.client(part), self.attempts)
        return out


def digest_embedding(text: Column, dim: int = 1536) -> Column:
    """A unit vector that depends on the text alone: native, equal in every process and engine.

    The text's SHA-256 with a block number after it is hashed once more for 16
    components of 16 bits each.
    """
    base = F.sha2(F.coalesce(text, F.lit("")), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.lit((dim - 1) // 16)), lambda j: F.sha2(F.concat(base, F.lit(":"), j.cast("string")), 256))
    quads = F.slice(F.flatten(F.transform(blocks, lambda h: F.regexp_extract_all(h, F.lit("...."), F.lit(0)))), 1, dim)
    raw = F.transform(quads, lambda q: F.conv(q, 16, 10).cast("double") / 32767.5 - 1)
    return l2_normalize(raw).cast("array<float>")


class LocalModel:
    """A sentence model of this machine, where the library and the model are installed."""

    def __init__(self, name: str):
        self.name = name
        self._model = None

    @classmethod
    def find(cls, name: str) -> LocalModel | None:
        """None where no such model can be loaded."""
        try:
            import sentence_transformers

            sentence_transformers.SentenceTransformer(name, local_files_only=True)
        except Exception:  # noqa: BLE001  whatever is missing, digests take its place
            return None
        return cls(name)

    def __getstate__(self):
        return {"name": self.name, "_model": None}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name, local_files_only=True)
        return [[float(x) for x in v] for v in self._model.encode(list(texts), normalize_embeddings=True)]


def embed_udf(provider: Provider):
    """An iterator UDF: the provider is opened once a worker, and gets whole Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider.embed([t or "" for t in s]))

    return run


def embedding(text: Column, settings: Settings, provider: Provider | None = None) -> Column:
    """By the settings: a given provider; for ``local`` a model of this machine, else digests; remote services need a client."""
    if provider is None and settings.provider == "local" and settings.embedding_model != DIGEST:
        provider = LocalModel.find(settings.embedding_model)
    if provider is not None:
        return embed_udf(provider)(text)
    if settings.provider == "local":
        return digest_embedding(text, settings.embed_dim)
    raise RuntimeError("the remote provider needs a client")


def embed_one(spark, text: str, settings: Settings, provider: Provider | None = None) -> list[float]:
    """The vector of one query."""
    if not text or not text.strip():
        raise ValueError("the query is blank")
    if provider is not None:
        return list(provider.embed([text])[0])
    return list(spark.range(1).select(embedding(F.lit(text), settings).alias("v")).first().v)
