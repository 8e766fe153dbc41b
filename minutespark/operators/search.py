"""Vector search over chunks and summaries, one query or many."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import clamp_top_k
from ..functions.vector import cosine, literal
from .bm25 import rerank, search as bm25_search

#: Queries scored in one pass over the corpus.
BLOCK = 256
#: Hits that are broadcast to the texts; more are joined.
FEW = 100_000


def check_query(query: str | None) -> str:
    if query is None or not query.strip():
        raise ValueError("the query is blank")
    return query


def _search(rows: DataFrame, metadata: DataFrame, query: Sequence[float], text: str, id_: str, top_k: int | None, ministry: str | None, embed_model: str | None) -> DataFrame:
    """Ids and scores alone are ordered; texts are fetched for the few that are left."""
    meta = metadata if ministry is None else metadata.filter(F.col("ministry") == ministry)
    if embed_model is not None:
        rows = rows.filter(F.col("embed_model") == embed_model)
    names = list(dict.fromkeys(["doc_id", id_]))
    scored = rows.select(*names, cosine(F.col("embedding"), literal(query)).alias("score")).join(meta.select("doc_id"), "doc_id", "left_semi")
    order = [F.desc_nulls_last("score"), F.asc(id_)]
    top = F.broadcast(scored.orderBy(*order).limit(clamp_top_k(top_k)))  # at most 100 rows
    found = rows.select(*names, text).join(top, names).join(meta.select("doc_id", "url", "council_name", "date"), "doc_id")
    found = found.orderBy(*order).limit(100)
    return found.select("url", "council_name", F.date_format("date", "yyyy-MM-dd").alias("date"), text, F.col("score").cast("double").alias("score"))


def search_chunks(chunks: DataFrame, metadata: DataFrame, query: Sequence[float], top_k: int | None = 5, ministry: str | None = None) -> DataFrame:
    """The nearest chunks, several of a document if they are; an empty ministry is a filter, None is not."""
    return _search(chunks, metadata, query, "chunk_text", "chunk_id", top_k, ministry, None)


def search_summaries(summaries: DataFrame, metadata: DataFrame, query: Sequence[float], top_k: int | None = 5, ministry: str | None = None, embed_model: str | None = None) -> DataFrame:
    return _search(summaries, metadata, query, "summary", "doc_id", top_k, ministry, embed_model)


def ranked(scored: DataFrame, group: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k of each group with their ``rank`` from 1; the limit is applied before the exchange too."""
    w = Window.partitionBy(*group).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows become nan."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def batch_search(rows: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], k: int = 20, id_: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank) of many queries.

    Queries travel as one matrix, BLOCK at a time, so each pass scans the corpus once
    and joins nothing: one product a batch of vectors, of which each query's first k
    go on.  Vectors of another length than the queries', and null ones, have no score
    and come last, as zero vectors do.
    """
    kind = rows.schema[id_].dataType.simpleString()
    parts = [rows.select(F.lit("").alias("query_id"), id_, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)] if not queries else []
    for at in range(0, len(queries), BLOCK):
        names = [q for q, _ in queries[at : at + BLOCK]]
        asked = _unit(np.array([v for _, v in queries[at : at + BLOCK]], dtype=np.float64))

        def best(batches: Iterator[pa.RecordBatch], names=names, asked=asked) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists, ids = b.column("v"), b.column(0)
                whole = pc.equal(pc.list_value_length(lists), asked.shape[1]).fill_null(False).to_numpy(zero_copy_only=False)
                base = np.full((len(ids), asked.shape[1]), np.nan)
                base[whole] = pc.list_flatten(lists.filter(pa.array(whole))).to_numpy(zero_copy_only=False).reshape(-1, asked.shape[1])
                scores = _unit(base) @ asked.T
                order = np.argsort(pc.rank(ids).to_numpy())  # ties by id
                top = [order[np.argsort(-np.nan_to_num(scores[order, q], nan=-np.inf), kind="stable")[:k]] for q in range(len(names))]
                picked = np.concatenate(top) if len(ids) else np.empty(0, np.int64)
                which = np.repeat(np.arange(len(names)), [len(t) for t in top])
                score = scores[picked, which]
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(which)), ids.take(pa.array(picked)), pa.array(score, mask=np.isnan(score))], ["query_id", id_, "score"])

        lists = rows.select(id_, F.col("embedding").cast("array<double>").alias("v")).mapInArrow(best, f"query_id string, {id_} {kind}, score double")
        parts.append(ranked(lists, ["query_id"], k, F.desc_nulls_last("score"), F.col(id_)))
    return reduce(DataFrame.unionByName, parts)


def ranked_urls(scores: DataFrame, index: DataFrame, limit: int = 20, key: str = "id") -> DataFrame:
    """(rank, url) of the highest scores; documents without a url are no hits."""
    hits = scores.join(index.filter("url is not null").select(key, "url"), key)
    top = hits.orderBy(F.desc("score"), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).select("rank", "url")


def keyword_search(index: DataFrame, terms: Column, query: Sequence[str], limit: int = 20, key: str = "id") -> DataFrame:
    """(rank, url) of the best documents by BM25, of those with a url, without an index."""
    urls = index.filter("url is not null")
    return ranked_urls(bm25_search(urls, terms, query, key), urls, limit, key)


def compare_runs(chunks: DataFrame, summaries: DataFrame, metadata: DataFrame, queries: Sequence[tuple[str, str, Sequence[float]]], tokenise, k: int = 20, store: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """The evaluation: chunk search, summary search, and the latter reordered by BM25 of its own candidates.

    ``queries`` holds (id, text, vector).  Columns are those of the evaluation file.
    The k hits of each query are stored: texts are fetched and reordered from there.
    """
    spark: SparkSession = chunks.sparkSession
    k = clamp_top_k(k)
    vectors = [(q, v) for q, _, v in queries]
    texts = spark.createDataFrame([(q, check_query(t)) for q, t, _ in queries], "query_id string, query_text string")
    meta = metadata.select("doc_id", "url")
    few = F.broadcast if k * len(queries) <= FEW else (lambda df: df)
    near_chunks = few(store(batch_search(chunks, vectors, k))).join(chunks.select("chunk_id", "doc_id", F.col("chunk_text").alias("text")), "chunk_id")
    near_sums = few(store(batch_search(summaries, vectors, k, "doc_id"))).join(summaries.select("doc_id", F.col("summary").alias("text")), "doc_id")
    near_sums = store(near_sums.join(F.broadcast(texts), "query_id"))
    again = rerank(near_sums, tokenise(F.col("text")), tokenise(F.col("query_text")), ["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "rank")
    reranked = again.select("query_id", "doc_id", "text", F.col("bm25").alias("score"), F.row_number().over(w).alias("rank"))
    names = ["query_id", "doc_id", "text", "score", "rank"]
    runs = [(near_chunks, "chunks"), (near_sums, "summaries"), (reranked, "rerank_summaries")]
    union = reduce(DataFrame.unionByName, [df.select(*names, F.lit(run).alias("run")) for df, run in runs])
    out = union.join(meta, "doc_id").join(F.broadcast(texts), "query_id")
    return out.select("query_id", "query_text", "run", "rank", "doc_id", "url", F.substring(F.coalesce("text", F.lit("")), 1, 50).alias("text_or_summary"), "score")


def lsh_search(rows: DataFrame, query: Sequence[float], k: int = 5, tables: int = 8, width: float = 0.5, id_: str = "chunk_id") -> DataFrame:
    """Approximate: candidates by random projections of unit vectors, then exact scores."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    from ..functions.vector import l2_normalize

    vectors = rows.select(id_, array_to_vector(l2_normalize(F.col("embedding"))).alias("v"))
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=width, seed=7).fit(vectors)
    near = model.approxNearestNeighbors(vectors, Vectors.dense([x / norm for x in query]), k)
    return near.select(id_, (1 - F.col("distCol") * F.col("distCol") / 2).alias("score"))


def health(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


def export_documents(metadata: DataFrame, summaries: DataFrame, tokenise, limit: int | None = 100) -> DataFrame:
    """Documents for the index, newest first, texts as tokens joined by blanks."""
    joined = metadata.select("doc_id", "url", "date", "discussion_text").join(summaries.select("doc_id", "summary"), "doc_id")
    if limit is not None:
        joined = joined.orderBy(F.desc_nulls_last("date"), "doc_id").limit(limit)
    return joined.select(F.col("doc_id").cast("string").alias("id"), "url", tokenise(F.col("summary")).alias("summary"), tokenise(F.col("discussion_text")).alias("discussion_text"))
