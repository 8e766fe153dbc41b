"""Keyword search: postings, corpus statistics and BM25 (Okapi)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, dl) of documents with distinct keys.

    All terms of a document stand in its row, so they are counted where they are
    read, a batch at a time, and nothing is exchanged.
    """
    rows = docs.select(F.col(key), terms.alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = pc.list_flatten(lists).dictionary_encode()
            pair = np.repeat(np.arange(len(size)), size) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            pair, n = np.unique(pair, return_counts=True)
            row, term = np.divmod(pair, max(1, len(coded.dictionary)))
            row_ = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row_), coded.dictionary.take(pa.array(term)), pa.array(n.astype(np.int64)), pa.array(size[row].astype(np.int32))], [key, "term", "tf", "dl"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, term string, tf long, dl int")


def search_postings(postings: DataFrame, statistics: DataFrame, query: Sequence[str], key: str = "doc_id") -> DataFrame:
    """As ``search``, from stored postings and statistics (one row): reads those of the query's terms alone."""
    asked = list(dict.fromkeys(query))
    if not asked:
        return postings.select(key, F.lit(0.0).alias("score")).limit(0)
    times = F.create_map(*[F.lit(x) for t in asked for x in (t, query.count(t))])
    hits = postings.filter(F.col("term").isin(asked))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each asked term
    raw = df.join(F.broadcast(statistics)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.avg("raw").over(Window.partitionBy(F.lit(0)))
    idf = raw.select("term", "avgdl", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))
    part = F.element_at(times, F.col("term")) * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(idf), "term").groupBy(key).agg(F.sum(part).alias("score"))


def statistics(docs: DataFrame, terms: Column) -> DataFrame:
    """One row: n documents, avgdl."""
    return docs.select(F.size(terms).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def search(docs: DataFrame, terms: Column, query: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, score) of the documents that hold a query term, over the whole corpus.

    Two scans and no shuffle of rows: one for the statistics (a single row: documents,
    mean length, and of each query term the documents that hold it), one that scores
    each document where it is read.  Repeated query terms count again.  Terms in over
    half of the documents have a negative idf, which EPSILON of the mean idf over the
    query's terms replaces.
    """
    asked = list(dict.fromkeys(query))
    if not asked:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*[F.lit(t) for t in asked])
    held = docs.select(key, terms.alias("terms")).select(key, F.size("terms").alias("dl"), F.filter("terms", lambda t: F.array_contains(wanted, t)).alias("hits"))
    dfs = [F.sum(F.array_contains("hits", t).cast("long")).alias(f"df{i}") for i, t in enumerate(asked)]
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *dfs)
    raw = [F.when(F.col(f"df{i}") > 0, F.log(F.col("n") - F.col(f"df{i}") + 0.5) - F.log(F.col(f"df{i}") + 0.5)).alias(f"raw{i}") for i in range(len(asked))]
    stats = stats.select("avgdl", *raw)
    known = F.array_compact(F.array(*[F.col(f"raw{i}") for i in range(len(asked))]))
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    idf = [F.when(F.col(f"raw{i}") < 0, EPSILON * mean).otherwise(F.col(f"raw{i}")).alias(f"idf{i}") for i in range(len(asked))]
    weights = F.broadcast(stats.select("avgdl", *idf))  # one row

    def part(i: int, term: str) -> Column:
        tf = F.size(F.filter("hits", lambda t: t == term))
        return F.coalesce(query.count(term) * F.col(f"idf{i}") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))), F.lit(0.0))

    total = sum((part(i, t) for i, t in enumerate(asked)), F.lit(0.0))
    return held.filter(F.size("hits") > 0).join(weights).select(key, total.alias("score"))


def rerank(candidates: DataFrame, terms: Column, query: Column, group: Sequence[str], key: str = "doc_id") -> DataFrame:
    """BM25 of each candidate within its own group (the candidates of one query): adds ``bm25``.

    Statistics are those of the group, mean idf over its distinct terms.  ``query``
    gives the group's query terms.  Candidates without a query term score zero.
    """
    g = list(group)
    rows = candidates.select(*g, key, terms.alias("terms"), query.alias("asked"))
    sized = rows.withColumn("dl", F.size("terms"))
    stats = sized.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.select(*g, key, "dl", "asked", F.explode("terms").alias("term")).groupBy(*g, key, "dl", "asked", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*g, "term").agg(F.count(F.lit(1)).alias("df")).join(stats, g)
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = raw.withColumn("mean", F.avg("raw").over(Window.partitionBy(*g))).select(*g, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    times = F.size(F.filter("asked", lambda t: t == F.col("term")))
    hit = tf.withColumn("times", times).filter("times > 0").join(idf, [*g, "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = hit.groupBy(*g, key).agg(F.sum(part).alias("bm25"))
    return candidates.join(scores, [*g, key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
