"""The driver's tables in the shape of the engine's: a row of each becomes one of ours.

documents are meetings; each pair of embeddings is two chunks of one meeting; a
document, and the embedding of its number (counted round), are its summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = """meta AS (SELECT doc_id, concat('doc://', doc_id) AS url, source AS ministry, concat('council ', doc_id % 7) AS council_name,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) END AS date, text AS discussion_text FROM documents)"""
CHUNKS = "chunks AS (SELECT vec_id AS chunk_id, vec_id // 2 AS doc_id, concat('chunk ', vec_id) AS chunk_text, embedding FROM embeddings)"
SUMMARIES = "summaries AS (SELECT d.doc_id, d.text AS summary, e.label, e.embedding FROM documents d JOIN embeddings e ON d.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id)"


#: Tables of long texts.
TEXTS = {"documents", "pages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer parts than there are cores is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc://"), "doc_id").alias("url"),
        F.col("source").alias("ministry"),
        F.concat(F.lit("council "), (F.col("doc_id") % 7).cast("string")).alias("council_name"),
        F.when(F.col("doc_id") % 11 != 0, day).alias("date"),
        F.col("text").alias("discussion_text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 2").alias("doc_id"), F.concat(F.lit("chunk "), "vec_id").alias("chunk_text"), "embedding")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("summary"))
    return d.join(e, F.col("doc_id") % e.count() == F.col("vec_id")).drop("vec_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crawled_pages: a minute between two fetches."""
    p = read(spark, sf_dir, "pages")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60)
    return p.select(F.col("page_id").alias("id"), "url", F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("content"), F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")).alias("html_title"), at.alias("fetched_at"))


def vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One query vector."""
    row = read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row.embedding)


def query_vectors(spark: SparkSession, sf_dir: str) -> list[tuple[str, list[float]]]:
    """The stated query set: every hundredth embedding."""
    rows = read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").orderBy("vec_id").collect()
    return [(str(r.vec_id), list(r.embedding)) for r in rows]
