"""The full-text index as tables: documents, postings and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25
from ..operators.search import ranked_urls
from ..operators.merge import swap_table, table_exists, upsert


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents")


def search_index(spark: SparkSession, path: str, query: Sequence[str], limit: int = 20) -> DataFrame:
    """(rank, url) from the stored postings of the asked terms: the cost follows the terms, not the corpus."""
    found = bm25.search_postings(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics"), query, "id")
    return ranked_urls(found, stored_documents(spark, path), limit)


def write_index(documents: DataFrame, path: str) -> None:
    """Upsert exported documents by id, then derive postings (term, id, tf, dl) and statistics anew."""
    spark = documents.sparkSession
    if table_exists(spark, f"{path}/documents"):
        documents = upsert(stored_documents(spark, path), documents, "id")
    swap_table(spark, documents, f"{path}/documents")
    found = stored_documents(spark, path)
    terms = index_terms()
    swap_table(spark, bm25.postings(found, terms, "id").sortWithinPartitions("term"), f"{path}/postings")
    swap_table(spark, bm25.statistics(found, terms), f"{path}/statistics")


def index_terms():
    """The tokens of an indexed document: its texts are tokens joined by blanks already."""
    text = F.lower(F.concat_ws(" ", "summary", "discussion_text"))
    return F.filter(F.split(text, " "), lambda t: t != "")
