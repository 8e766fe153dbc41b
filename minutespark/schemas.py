"""The tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DateType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _table(*columns: tuple) -> StructType:
    return StructType([StructField(c[0], c[1], len(c) < 3) for c in columns])


S, L, N, T = StringType(), LongType(), IntegerType(), TimestampType()
VECTOR = ArrayType(FloatType(), False)

CRAWLED_PAGES = _table(("id", L, 1), ("url", S, 1), ("referrer_anchor_text", S), ("status_code", N), ("content_type", S), ("content", BinaryType()), ("html_title", S), ("depth", N), ("fetched_at", T, 1))
MEETING_METADATA = _table(("doc_id", S, 1), ("url", S, 1), ("ministry", S), ("council_name", S), ("meeting_no", S), ("date", DateType()), ("location", S), ("attendees", ArrayType(S)), ("agenda", S), ("discussion_text", S))
MEETING_CHUNKS = _table(("chunk_id", L, 1), ("doc_id", S), ("chunk_text", S, 1), ("embedding", VECTOR))
CHUNKS_SUMMARY = _table(("doc_id", S, 1), ("summary", S, 1), ("topics", ArrayType(S)), ("model", S), ("embed_model", S), ("embedding", VECTOR, 1), ("created_at", T))
SUMMARY_JOBS = _table(("doc_id", S, 1), ("status", S), ("last_error", S), ("updated_at", T))
INDEX_DOCUMENTS = _table(("id", S, 1), ("url", S), ("summary", S), ("discussion_text", S))
EVAL_QUERIES = _table(("query_id", S), ("query_text", S))
EVAL_RESULTS = _table(("query_id", S), ("query_text", S), ("run", S), ("rank", N), ("doc_id", S), ("url", S), ("text_or_summary", S), ("score", S))

TABLES = {
    "crawled_pages": CRAWLED_PAGES,
    "meeting_metadata": MEETING_METADATA,
    "meeting_chunks": MEETING_CHUNKS,
    "chunks_summary": CHUNKS_SUMMARY,
    "chunks_summary_jobs": SUMMARY_JOBS,
    "index_documents": INDEX_DOCUMENTS,
}
#: Columns whose values may occur once in a table.
UNIQUE = {"crawled_pages": ["url"], "meeting_metadata": ["url", "doc_id"], "chunks_summary": ["doc_id"], "chunks_summary_jobs": ["doc_id"]}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


#: Tables that are joined by this key are bucketed by it, in the place of an index.
BUCKETED = {"meeting_metadata": "doc_id", "meeting_chunks": "doc_id", "chunks_summary": "doc_id", "chunks_summary_jobs": "doc_id"}


def create_tables(spark: SparkSession, database: str = "default", buckets: int = 64) -> None:
    """CREATE TABLE IF NOT EXISTS for all of them, as Parquet.

    Joins of two bucketed tables by their key shuffle neither; ``buckets`` grows with
    the tables (a bucket should fit in a task).
    """
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        key = BUCKETED.get(name)
        dealt = f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{dealt}")


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """A missing table is an empty one."""
    return spark.table(table) if spark.catalog.tableExists(table) else empty(spark, table.rpartition(".")[2])


def with_defaults(df: DataFrame) -> DataFrame:
    """Column defaults: time of writing, no topics."""
    if "created_at" in df.columns:
        df = df.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    if "fetched_at" in df.columns:
        df = df.withColumn("fetched_at", F.coalesce("fetched_at", F.current_timestamp()))
    if "topics" in df.columns:
        df = df.withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return df


def unique_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; none in a sound table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
