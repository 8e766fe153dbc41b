"""Tokenisers for keyword search."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of one script: kanji, hiragana, katakana, else letters and digits.
RUNS = r"[\p{IsHan}々]+|[\p{IsHiragana}]+|[\p{IsKatakana}ー]+|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"


def tokens(x: Column, lower: bool = True) -> Column:
    """Words; of kanji runs longer than two, all pairs of neighbours.

    A stand-in for a morphological analyser, which can be given to ``token_udf``.
    """
    t = F.lower(F.coalesce(x, F.lit(""))) if lower else F.coalesce(x, F.lit(""))
    runs = F.regexp_extract_all(t, F.lit(RUNS), F.lit(0))
    pairs = F.transform(
        runs,
        lambda r: F.when(r.rlike(r"\A[\p{IsHan}々]{3,}\z"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r)),
    )
    # only texts with such a run pay for the pairs
    return F.when(t.rlike(r"[\p{IsHan}々]{3}"), F.flatten(pairs)).otherwise(runs)


def token_text(x: Column) -> Column:
    """Tokens joined by blanks; empty for null and empty texts."""
    return F.array_join(tokens(x, lower=False), " ")


def token_udf(analyse: Callable[[str], list[str]]):
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: analyse(t) if t else [])

    return run
