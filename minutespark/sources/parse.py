"""Documents to text: HTML, PDF and plain bytes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

_SILENT = {"script", "style", "noscript"}
_REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")
#: Stands for an ampersand that is text; no character, so no page holds it.
_AMPERSAND = "\ufdd0"


class _Text(HTMLParser):
    """Text nodes outside of scripts and styles; comments and tags end a node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self._silent = 0
        self._in_title = self._seen_title = False

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self._silent += 1
        elif tag == "title" and not self._seen_title:
            self._in_title = self._seen_title = True

    def handle_endtag(self, tag):
        if tag in _SILENT and self._silent:
            self._silent -= 1
        elif tag == "title":
            self._in_title = False

    def handle_data(self, data):
        if not self._silent:
            self.parts.append(data)
            if self._in_title:
                self.title.append(data)


def _ended(m: re.Match) -> str:
    known = m[0] != "&" and (m[1] is None or m[1] in html5)
    return m[0] if known else _AMPERSAND + m[0][1:]


def html_text(content: bytes | str | None, ended: bool = False) -> str:
    """The title, then all text nodes (the title among them), one a line; not yet cleaned.

    Browsers read some names without a semicolon (``&amp``, as where a title is cut);
    with ``ended`` these are text, and only what a semicolon ends is a reference.
    """
    if content is None:
        return ""
    raw = content.decode("utf-8", "ignore") if isinstance(content, (bytes, bytearray)) else content
    p = _Text()
    p.feed(_REFERENCE.sub(_ended, raw) if ended else raw)
    p.close()
    found = "".join(p.title).strip() + "\n" + "\n".join(p.parts)
    return found.replace(_AMPERSAND, "&") if ended else found


def pdf_text(content: bytes | None) -> str:
    """Pages joined by an empty line; empty where no PDF library is installed or the file is broken."""
    if not content:
        return ""
    try:
        import fitz
    except ImportError:
        return ""
    pages = []
    try:
        with fitz.open(stream=bytes(content), filetype="pdf") as doc:
            for page in doc:
                try:
                    pages.append(page.get_text())
                except Exception:  # noqa: BLE001  a broken page is skipped
                    continue
    except Exception:  # noqa: BLE001  a broken file is empty
        return ""
    return "\n\n".join(pages)


def _udf(parse: Callable[[bytes | None], str]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: parse(bytes(b)) if b is not None else "")

    return run


def decoded(content: Column) -> Column:
    """UTF-8 with broken bytes ignored (the built-in raises on them)."""
    return _udf(lambda b: bytes(b).decode("utf-8", "ignore"))(content)


def html_to_text(content: Column, ended: bool = False) -> Column:
    return clean_text(_udf(partial(html_text, ended=ended))(content))


def html_to_text_plain(raw: Column, normalized: bool = False) -> Column:
    """The fallback: every tag becomes a line end.  Native."""
    return clean_text(F.regexp_replace(raw, r"<[^>]+>", "\n"), normalized)


def pdf_to_text(content: Column, parse: Callable[[bytes | None], str] = pdf_text) -> Column:
    return clean_text(_udf(parse)(content))


def parse_content(rows: DataFrame, parse_pdf: Callable[[bytes | None], str] = pdf_text, ended: bool = False) -> DataFrame:
    """``text`` from ``content`` by ``content_type``: HTML, PDF, else HTML and, if that is short, PDF.

    Each kind is a branch of its own, so a row meets the parsers it needs alone.
    Null and empty contents give empty texts.  ``ended`` is html_text's.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    empty = F.coalesce(F.length("content"), F.lit(0)) == 0
    is_html, is_pdf = kind.startswith("text/html"), kind.startswith("application/pdf")
    none = rows.filter(empty).withColumn("text", F.lit(""))
    html = rows.filter(~empty & is_html).withColumn("text", html_to_text(F.col("content"), ended))
    pdf = rows.filter(~empty & is_pdf & ~is_html).withColumn("text", pdf_to_text(F.col("content"), parse_pdf))
    rest = rows.filter(~empty & ~is_html & ~is_pdf)

    @F.pandas_udf("string")
    def either(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            text = html_text(b, ended)
            return text if len(text.strip()) >= 50 else parse_pdf(b) or text

        return s.map(lambda b: one(bytes(b)))

    other = rest.withColumn("text", clean_text(either(F.col("content"))))
    return none.unionByName(html).unionByName(pdf).unionByName(other)
