"""Summaries by map and reduce: chunks, partial summaries, two levels of merging, validation."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import sentence_chunk_array
from ..functions.text import normalize_text, strip
from .embed import with_retry

#: Shorter chunks are left out; up to ONE_PASS partials are merged at once, else in groups.
SHORTEST, ONE_PASS, GROUP = 20, 20, 10
SUMMARY_CHARS, TOPIC_COUNT, TOPIC_CHARS = (100, 1500), (3, 8), 20


class Summarizer(Protocol):
    """Both answers are JSON texts: {"summary"} of a chunk, {"summary", "topics"} of partials."""

    def map_chunk(self, chunk: str, nudge: bool = False) -> str: ...

    def reduce(self, partials: list[str], note: str | None = None) -> str: ...


class Extractive:
    """Deterministic and offline: leading sentences, and the most frequent words as topics."""

    def map_chunk(self, chunk: str, nudge: bool = False) -> str:
        return json.dumps({"summary": " ".join(chunk.split())[:300]}, ensure_ascii=False)

    def reduce(self, partials: list[str], note: str | None = None) -> str:
        text = " ".join(partials)
        words: dict[str, int] = {}
        for w in text.lower().split():
            w = w.strip(".,;:!?()\"'。、")
            if len(w) > 3:
                words[w] = words.get(w, 0) + 1
        topics = sorted(words, key=lambda w: (-words[w], w))[:5]
        return json.dumps({"summary": text[:1200], "topics": topics}, ensure_ascii=False)


def bullets(parts: list[str]) -> str:
    return "\n".join("- " + p for p in parts)


def bullet_column(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("- "), p)), "\n")


_TASK = "You condense minutes of meetings. Answer with one JSON object and nothing else."
_MAP = 'Summarise this part of the minutes in 200 to 300 characters, as {"summary": "..."}.'
_NUDGE = "The last answer could not be read: write the JSON object alone."
_REDUCE = 'Merge these partial summaries into one of 200 to 1200 characters, with three to eight short topics, as {"summary": "...", "topics": ["..."]}.'


class Chat:
    """A remote chat model behind an injected client.

    ``client(messages, model=, timeout=, response_format=)`` returns the answer's text;
    it is made by ``connect`` once a worker, so it need not travel.
    """

    def __init__(self, connect: Callable[[], Callable[..., str]], model: str, timeout: float = 60.0):
        self.connect, self.model, self.timeout = connect, model, timeout
        self._client: Callable[..., str] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_client": None}

    def _ask(self, *parts: str) -> str:
        self._client = self._client or self.connect()
        messages = [{"role": "system", "content": _TASK}, {"role": "user", "content": "\n\n".join(parts)}]
        return self._client(messages, model=self.model, timeout=self.timeout, response_format={"type": "json_object"})

    def map_chunk(self, chunk: str, nudge: bool = False) -> str:
        return self._ask(_MAP, *([_NUDGE] if nudge else []), chunk)

    def reduce(self, partials: list[str], note: str | None = None) -> str:
        return self._ask(_REDUCE, *([note] if note else []), bullets(partials))


def parse_json_strict(text: str) -> dict:
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("the answer is no JSON object")
    return found


def json_object(x: Column) -> Column:
    """The text as a variant if it is a JSON object, else null."""
    v = F.try_parse_json(x)
    # the parser stops behind the first value; within brackets anything more is seen
    one = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    alone = F.schema_of_variant(one).startswith("ARRAY<OBJECT") & F.try_variant_get(one, "$[1]", "string").isNull()
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & alone, v)


def topics_normalized(topics: Column, normalized: bool = False) -> Column:
    """Stripped, lower case, cut, blanks dropped, each once in the order of appearance."""
    cut = F.transform(topics, lambda t: F.substring(strip(F.lower(t if normalized else F.coalesce(t, F.lit("")))), 1, TOPIC_CHARS))
    return F.array_distinct(F.filter(cut, lambda t: F.coalesce(t, F.lit("")) != ""))


def length_ok(summary: Column) -> Column:
    return F.coalesce(F.length(strip(summary)).between(*SUMMARY_CHARS), F.lit(False))


def topics_ok(topics: Column) -> Column:
    return F.coalesce(F.size(topics).between(*TOPIC_COUNT), F.lit(False))


def validate(found: dict) -> tuple[str, list[str]]:
    """The same on one answer; raises on the first fault.  Too many topics are a fault too."""
    summary = str(found["summary"]).strip()
    seen: dict[str, None] = {}
    for t in found["topics"]:
        if isinstance(t, str) and (t := unicodedata.normalize("NFKC", t).lower().strip()[:TOPIC_CHARS]):
            seen.setdefault(t)
    if not SUMMARY_CHARS[0] <= len(summary) <= SUMMARY_CHARS[1]:
        raise ValueError(f"summary of {len(summary)} characters")
    if not TOPIC_COUNT[0] <= len(seen) <= TOPIC_COUNT[1]:
        raise ValueError(f"{len(seen)} topics")
    return summary, list(seen)


def _answer(ask: Callable[[], str], attempts: int, topics: bool) -> dict:
    """An answer of the right shape; the parsing is retried with the call."""

    def once() -> dict:
        found = parse_json_strict(ask())
        if not isinstance(found.get("summary"), str) or topics and not isinstance(found.get("topics"), list):
            raise ValueError("the answer lacks a field")
        return found

    return with_retry(once, attempts)


def map_udf(model: Summarizer, attempts: int = 3):
    """struct(value, error) of each chunk; after the last failure once more with a nudge."""

    def one(chunk: str) -> tuple[str | None, str | None]:
        try:
            return _answer(lambda: model.map_chunk(chunk), attempts, False)["summary"].strip(), None
        except Exception:  # noqa: BLE001
            try:
                return _answer(lambda: model.map_chunk(chunk, nudge=True), attempts, False)["summary"].strip(), None
            except Exception as e:  # noqa: BLE001  the document fails, not the job
                return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("value string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c) for c in s], columns=["value", "error"])

    return run


def reduce_levels(model: Summarizer, partials: list[str], attempts: int, note: str | None = None) -> dict:
    """Exactly two levels: groups of GROUP where there are more than ONE_PASS."""
    parts = [note, *partials] if note else list(partials)
    if len(parts) > ONE_PASS:
        parts = [_answer(lambda g=parts[i : i + GROUP]: model.reduce(g), attempts, True)["summary"] for i in range(0, len(parts), GROUP)]
    return _answer(lambda: model.reduce(parts), attempts, True)


def reduce_udf(model: Summarizer, attempts: int = 3):
    """struct(summary, topics, error); an invalid answer is asked for once more with a note."""

    def one(partials) -> tuple[str | None, list[str] | None, str | None]:
        if partials is None:  # a UDF runs for every row, whatever stands around it
            return None, None, None
        partials = list(partials)
        try:
            try:
                return *validate(reduce_levels(model, partials, attempts)), None
            except ValueError as e:
                return *validate(reduce_levels(model, partials, attempts, f"Keep to the limits ({e}).")), None
        except Exception as e:  # noqa: BLE001
            return None, None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("summary string, topics array<string>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in s], columns=["summary", "topics", "error"])

    return run


def partial_groups(partials: DataFrame, group: int = GROUP) -> DataFrame:
    """Partials by (doc_id, pos div group), in the order of pos."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "partial"))), lambda x: x["partial"])
    return partials.groupBy("doc_id", F.floor(F.col("pos") / group).alias("group")).agg(ordered.alias("partials"))


def summarize(pending: DataFrame, model: Summarizer | None = None, size: int = 2000, overlap: int = 200, attempts: int = 3, throttle: int | None = None) -> DataFrame:
    """doc_id, summary, topics, n_chunks, status, error of every pending document.

    A failing document gets an error, never the job.  ``throttle`` bounds the tasks
    that ask the model at once.
    """
    model = model or Extractive()
    chunks = pending.select("doc_id", F.posexplode(F.filter(sentence_chunk_array(normalize_text(F.col("discussion_text")), size, overlap), lambda c: F.length(c) >= SHORTEST)).alias("pos", "chunk"))
    if throttle:
        chunks = chunks.repartition(throttle)
    mapped = chunks.withColumn("m", map_udf(model, attempts)(F.col("chunk")))
    # partial summaries of one document: a few hundred characters a chunk
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]["value"])
    docs = mapped.groupBy("doc_id").agg(ordered.alias("partials"), F.count(F.lit(1)).alias("n_chunks"), F.max("m.error").alias("map_error"))
    done = docs.withColumn("r", reduce_udf(model, attempts)(F.when(F.col("map_error").isNull(), F.col("partials"))))
    all_ = pending.select("doc_id").join(done, "doc_id", "left")
    error = F.coalesce("map_error", "r.error", F.when(F.col("n_chunks").isNull(), F.lit("no chunks")))
    return all_.select("doc_id", F.when(error.isNull(), F.col("r.summary")).alias("summary"), F.when(error.isNull(), F.col("r.topics")).alias("topics"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(error.isNull(), "done").otherwise("error").alias("status"), error.alias("error"))
