"""Incremental runs: new pages stream through the normaliser and are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest, swap_table, table_exists, upsert_metadata
from ..plans.jobs import metadata_rows
from ..schemas import CRAWLED_PAGES, MEETING_METADATA, empty
from ..sources.parse import parse_content


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CRAWLED_PAGES).parquet(folder)


def merge_batch(batch: DataFrame, path: str) -> None:
    """Idempotent: a batch that runs again writes the same rows."""
    spark = batch.sparkSession
    known = spark.read.schema(MEETING_METADATA).parquet(path) if table_exists(spark, path) else empty(spark, "meeting_metadata")
    rows = metadata_rows(latest(parse_content(batch).select("url", "text", "html_title", "id"), "url", F.desc("id")))
    swap_table(spark, upsert_metadata(known, rows.filter("status = 'ok'").drop("status")), path)


def run_available(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Process what is there, then stop."""
    query = stream_pages(spark, folder).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: merge_batch(df, table)).start()
    query.awaitTermination()
