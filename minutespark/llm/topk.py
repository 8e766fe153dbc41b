"""Exact top-k search: tiled matrix products with partial selection and tree merging.

Base rows are dealt over tiles by a hash of their content, queries over blocks.  Each
(tile, block) pair is one product of two bounded matrices; of each query only its best
k of the tile leave the task.  The lists then merge in a tree: ``FAN`` neighbouring
tiles make a branch, branches make larger ones, so no task sees more than ``FAN``
lists of a query.

The tile and block counts follow the table: both kinds of row are repeated once
per partner, which the products outweigh by far.

Vectors that are null, or hold null or non-finite components, take no part.
Vectors meet only others of their length; an empty vector scores zero with any
other empty one.  Rows with a null id take no part.  Repeated ids: each row is a
candidate of its own, and rows with the query's id are none of its candidates.  Rows
alike in id and vector are counted first; k of them are enough.  Fewer than k
candidates give all there are; an empty table gives no rows.  Scores beyond 64 bits
are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import require

SCALE = 256
#: Rows of a tile and of a block of queries, on average.
TILE = 16384
BLOCK = 4096
#: Lists of one query that merge in one place.
FAN = 64
#: Products held at once, as rows of queries times columns of a tile.
HELD = 1 << 22


def quantized(vector: Column) -> Column:
    """floor(256 x) of each component in double precision; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by the fastest arithmetic that is exact."""
    dim = max(1, a.shape[1])
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dim
    if most >= 1 << 63:  # Python's integers; what does not fit in the end is an error
        return np.array([[int(x) for x in row] for row in a.astype(object) @ b.astype(object).T], dtype=np.int64).reshape(len(a), len(b))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of one query, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _tile_lists(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("tile", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, base: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(base) or not len(queries):
            return schema.empty_table()
        ids, asked = base.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        b, q = _matrix(base.column("v"), len(ids)), _matrix(queries.column("v"), len(asked))
        out: list[list[np.ndarray]] = [[], [], []]
        step = max(1, HELD // max(1, len(ids)))
        for at in range(0, len(asked), step):
            scores = _products(q[at : at + step], b)
            own = asked[at : at + step, None] == ids[None, :]
            for i, s in enumerate(scores):
                there = np.flatnonzero(~own[i])
                best = there[_best(s[there], ids[there], k)]
                out[0].append(np.full(len(best), asked[at + i]))
                out[1].append(ids[best])
                out[2].append(s[best])
        query, vec, score = (np.concatenate(x).astype(np.int64) for x in out)
        return pa.Table.from_arrays([pa.array(query), pa.array(np.full(len(query), key[0].as_py(), np.int32)), pa.array(vec), pa.array(score)], schema=schema)

    return run


def top_k(base: DataFrame, queries: DataFrame, k: int = 5, tile: int = TILE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """query_id, rank, vec_id, score.  ``base`` has vec_id and v, ``queries`` query_id and v (arrays of long)."""
    require(base, ["vec_id", "v"])
    require(queries, ["query_id", "v"])
    spark = base.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    (n, a), (q, b) = (df.agg(F.count(F.lit(1)), largest).first() for df in (base, queries))
    # the components travel in the narrowest integers that hold them all
    kind = next(t for t, most in (("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 64)) if max(a or 0, b or 0) < most)
    base = base.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    blocks = max(1, -(-q // block))
    tiles = max(1, -(-n // tile), -(-least // blocks) if n > 64 * least else 1)

    def spread(df: DataFrame, own: str, own_n: int, other: str, other_n: int, name: str, *key: str) -> DataFrame:
        # by content: a task that runs again deals every row as before
        place = F.pmod(F.xxhash64(name, "v", *key), F.lit(own_n)).cast("int")
        return df.select(name, F.col("v").cast(f"array<{kind}>").alias("v"), F.size("v").alias("dim"), place.alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    keys = ["tile", "block", "dim"]
    left = spread(base, "tile", tiles, "block", blocks, "vec_id", "copy").groupBy(*keys)
    right = spread(queries, "block", blocks, "tile", tiles, "query_id").groupBy(*keys)
    lists = left.cogroup(right).applyInArrow(_tile_lists(k), "query_id long, tile int, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    width = tiles
    while width > fan:
        width = -(-width // fan)
        lists = lists.withColumn("tile", F.floor(F.col("tile") / fan).cast("int"))
        part = Window.partitionBy("query_id", "tile").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k).drop("rank")
    final = Window.partitionBy("query_id").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), quantized(F.col("embedding")).alias("v")).filter("v is not null and vec_id is not null")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return top_k(rows, queries)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, b.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e b ON q.vec_id <> b.vec_id AND len(q.v) = len(b.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op2_topk": op2_topk}
ORACLES = {"op2_topk": OP2_SQL}
