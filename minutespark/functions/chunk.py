"""Cutting texts into chunks."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: Up to so many characters a text is one chunk for the sentence cutter; shorter chunks do not overlap.
MIN_SIZE = 1500
#: A window ends at a full stop that lies within so many characters of its end.
REACH = 200


def chunk_array(x: Column, target: int = 1000, overlap: int = 100) -> Column:
    """Windows of ``target`` characters that overlap; each stripped, blank ones dropped."""
    if target <= 0:
        raise ValueError("target must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    step = target - min(overlap, target - 1)
    t = strip(F.coalesce(x, F.lit("")))
    # blocks of one step each, cut in one pass; a window is a few of them joined
    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    width = -(-target // step)

    def windows(bound: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), _windows(bound, target, step)))
        return F.transform(starts, lambda i: strip(F.substring(F.array_join(F.slice(bound, i, F.lit(width)), ""), F.lit(1), F.lit(target))))

    # bound once: what a lambda names from outside is evaluated for each element
    return F.filter(F.flatten(F.transform(F.array(blocks), windows)), lambda s: s != "")


def _windows(blocks: Column, target: int, step: int) -> Column:
    """How many windows reach the end: 1 + ceil((n - target) / step) for n characters."""
    size = F.size(blocks)
    n = (size - 1) * step + F.length(F.coalesce(F.get(blocks, size - 1), F.lit("")))
    return F.ceil(F.greatest(n - target, F.lit(0)) / F.lit(step)).cast("int") + 1


def explode_chunks(df: DataFrame, chunks: Column, name: str = "chunk_text") -> DataFrame:
    """One row per chunk, numbered from 0 in ``pos``."""
    return df.select("*", F.posexplode(chunks).alias("pos", name))


def sentence_chunks(text: str | None, size: int = 2000, overlap: int = 200, min_size: int = MIN_SIZE) -> list[str]:
    """Windows that end behind a full stop where one is near; the model of ``sentence_chunk_array``.

    All full stops are found in one pass; each window looks up the last within reach.
    Only a window of ``min_size`` characters or more is overlapped by the next.
    """
    text = text or ""
    if size <= 0 or len(text) <= min_size:
        return [text.strip()]
    stops = [m.end() for m in re.finditer("。", text)]
    pieces, begin, end = [], 0, 0
    while end < len(text):
        reach = min(begin + size, len(text))
        last = bisect_right(stops, reach) - 1
        near = last >= 0 and stops[last] > begin and stops[last] >= reach - REACH
        end = stops[last] if near else reach
        pieces.append(text[begin:end].strip())
        back = overlap if len(pieces[-1]) >= min_size else 0
        begin = max(begin + 1, end - back)
    return [p for p in pieces if p]


def sentence_chunk_array(x: Column, size: int = 2000, overlap: int = 200, min_size: int = MIN_SIZE) -> Column:
    """Each window depends on the last one's end, so this runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sentence_chunks(t, size, overlap, min_size))

    return cut(x)


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\n\n+"), strip), lambda s: s != "")


def split_dropping(x: Column, pattern: str) -> Column:
    """Parts between matches; the matches are dropped."""
    return F.split(x, pattern)
