"""Text cleaning as column functions.  White space and line ends are Python's, in Java regexes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside [...]: what str.strip() strips.
W = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where str.splitlines() splits.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Inside [...]: what ends a line; and all ends but the line feed.
ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
OTHER_END = r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Inside [...]: white space that ends no line.
H = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: A whole line, between line feeds alone.
PAGE_NUMBER = r"(?md)^-? ?\p{Nd}+ ?-?$\n?"
FULL_WIDTH = "０１２３４５６７８９"


def _nfkc_one(x: str | None) -> str | None:
    return x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)


def nfkc(x: Column) -> Column:
    """Unicode NFKC.  There is no built-in; ASCII is passed through."""

    # made on the driver alone: workers import this module too
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_nfkc_one, na_action="ignore")

    return run(x)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A[{W}]+|[{W}]+\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"[{W}]+\z", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, rf"[{W}]+", " ")


def lines(x: Column) -> Column:
    """A last empty line, which splitlines() would not give, is harmless to all callers."""
    return F.split(x, LINE_END)


def half_width_digits(x: Column) -> Column:
    return F.translate(x, FULL_WIDTH, "0123456789")


def _even(x: Column, normalized: bool) -> Column:
    """One kind of line end, runs of other white space as one blank, none before a line end.  Whole texts at a time."""
    t = F.coalesce(x if normalized else nfkc(x), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, OTHER_END, "\n"), f"[{H}]+", " "), " \n", "\n")


def _paragraphs(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_text(x: Column, normalized: bool = False) -> Column:
    """NFKC; lines stripped, page numbers dropped, blanks collapsed; at most one empty line in a row."""
    return _paragraphs(F.regexp_replace(F.regexp_replace(strip(_even(x, normalized)), "\n ", "\n"), PAGE_NUMBER, ""))


def normalize_text(x: Column, normalized: bool = False) -> Column:
    """As clean_text, but only line ends are stripped and page numbers stay."""
    return _paragraphs(_even(x, normalized))


def first_chars(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def one_line(x: Column) -> Column:
    return F.replace(x, F.lit("\n"), F.lit(" "))


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
