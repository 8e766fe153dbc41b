"""Pending work, as anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_pages(pages: DataFrame, metadata: DataFrame, limit: int | None = 100, refresh: bool = False) -> DataFrame:
    """Pages whose url is not known yet, newest first."""
    found = pages if refresh else pages.join(metadata.select("url"), "url", "left_anti")
    return found if limit is None else found.orderBy(F.desc("fetched_at"), "id").limit(limit)


def _pending(metadata: DataFrame, done: DataFrame, limit: int | None, jobs: DataFrame | None, attempts: int | None) -> DataFrame:
    found = metadata.filter(F.length("discussion_text") > 0).join(done.select("doc_id"), "doc_id", "left_anti")
    if jobs is not None and attempts is not None:
        failed = jobs.filter("status = 'error'").groupBy("doc_id").count().filter(F.col("count") >= attempts)
        found = found.join(failed.select("doc_id"), "doc_id", "left_anti")
    return found if limit is None else found.orderBy("doc_id").limit(limit)


def pending_embed(metadata: DataFrame, chunks: DataFrame, limit: int | None = 50, jobs: DataFrame | None = None, attempts: int | None = None) -> DataFrame:
    """Documents with text and without chunks; optionally without those that failed so often."""
    return _pending(metadata, chunks, limit, jobs, attempts)


def pending_summary(metadata: DataFrame, summaries: DataFrame, limit: int | None = 20, jobs: DataFrame | None = None, attempts: int | None = None) -> DataFrame:
    return _pending(metadata, summaries, limit, jobs, attempts)
